import re

from pyspark.sql import functions as F

from tablescope.llm.surrogates import replace_entities

from .helpers import no_docs, odd_docs, odd_rows

TEXTS = [
    "Mr. John Smith met Frau Meyer and Mr Smith. Mail: John.Smith@Example.com or john.smith@example.com, ip 97.51.17.173.",
    "call +1 (017) 555-7713, or +10175557713; card 4111 1111 1111 1111 and 4111111111111111; 9807915762804490",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and TOKEN = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962"!!',
    "госпожа Иванова 123-45-6789 DE89 3704 0044 0532 0130 00", "version 2.0, 3 of 4 in 2024-01-02", "a@b.co\nz.y@x.org"]


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def test_forms_coreference_and_distinctness(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r for r in replace_entities(docs, "secret").collect()}
    one, two, three, four = (got[i].text for i in range(4))
    first = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+) and Mr (\w+)\. Mail: (\S+) or (\S+), ip ([\d.]+)\.", one)
    assert first[2] == first[4] != first[3] and first[1][0].isupper() and first[5].lower() == first[6] and first[6].endswith(".com")
    assert all(1 <= int(o) <= 255 for o in first[7].split(".")) and first[7] != "97.51.17.173"
    second = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}), or \+1(\d{10}); card ([\d ]{19}) and (\d{16}); (\d{16})", two)
    assert second[1] + second[2] + second[3] == second[4] and second[5].replace(" ", "") == second[6] != second[7]
    assert luhn(second[6]) and "0175557713" not in two
    third = re.fullmatch(r'token = "([0-9a-f]{40})" and TOKEN = "([0-9A-F]{40})"!!', three)
    assert third[1].upper() == third[2] and third[1] != "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert re.fullmatch(r"госпожа [А-Я][а-я]+ \d{3}-\d{2}-\d{4} [A-Z]{2}\d{2} .{22}", four) and "Иванова" not in four
    assert (got[4].text, got[4].n_entities) == (TEXTS[4], 0) and got[0].n_entities == 6
    again = {r.doc_id: r.text for r in replace_entities(docs, "secret").collect()}
    other = {r.doc_id: r.text for r in replace_entities(docs, "another").collect()}
    assert again == {k: r.text for k, r in got.items()} and other[0] != again[0]


def test_crowded_forms_stay_distinct(spark):
    """Ten secrets with one free character, all octets of one digit in use: later draws are longer."""
    docs = spark.createDataFrame([(i, f'token = "{i}*****" and {i}.1.1.1 and {chr(97 + i)}@c.de') for i in range(10)], "doc_id int, text string")
    texts = [r.text for r in replace_entities(docs, "k").collect()]
    secrets = [re.search(r'"(.+?)"', t)[1] for t in texts]
    assert len(set(secrets)) == 10 and not any(re.fullmatch(r"\d\*{5}", s) for s in secrets)
    assert len({t.split(" and ")[1] for t in texts}) == 10 and len({t.split(" and ")[2] for t in texts}) == 10


def test_odd_rows(spark):
    got = replace_entities(odd_docs(spark), "k").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for d, t, *_ in odd_rows())
    assert all(r.n_entities == 0 for r in got) and replace_entities(no_docs(spark), "k").collect() == []


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").where(F.col("doc_id") >= 0)
    plan = replace_entities(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
