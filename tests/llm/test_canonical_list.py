import pytest

from callmetrics.llm import canonical_list, queries

LIST = [(1, "court records", ["case law", "litigation files"]), (2, "banking and payments", ["money transfer"]), (3, "statistics", None), (4, "folders", []), (None, "astronomy", [])]


@pytest.fixture(scope="module")
def mapped(spark):
    values = ["Court  Records", "courtrecords", "records/court", "payments, banking", "[court records]", "our court records", "court records / v2", "clue", "cuort recoras", "court ercrods", "banki. payme.", "Statitics", "stati.",
              "FOLDRES", "astronomy", "x", "", "   ", None, "?!", "z" * 5000, "litigatoin fles", "lit. fil.", "cave diving", "money-transfer", "sasela gikago", "our cuort records", "our litigatoin fles"]
    df = spark.createDataFrame([(v, 1) for v in values] * 2, "v string, id int")
    ref = spark.createDataFrame(LIST, "id long, name string, aliases array<string>")
    found = canonical_list.mapped(df, ref)
    return {r.v: r.id for r in found.collect()}, {r.v for r in canonical_list.unmatched(df, found).collect()}


def test_forms(mapped):
    want = {"Court  Records": 1, "courtrecords": 1, "records/court": 1, "payments, banking": 2, "[court records]": 1, "our court records": 1, "court records / v2": 1, "cuort recoras": 1, "court ercrods": 1, "banki. payme.": 2,
            "Statitics": 3, "stati.": 3, "FOLDRES": 4, "litigatoin fles": 1, "lit. fil.": 1, "money-transfer": 2}
    assert mapped[0] == want


def test_unmatched(mapped):
    assert mapped[1] == {"clue", "astronomy", "x", "?!", "z" * 5000, "cave diving", "sasela gikago", "our cuort records", "our litigatoin fles"}


def test_empty(spark):
    ref = spark.createDataFrame(LIST, "id long, name string, aliases array<string>")
    none = spark.createDataFrame([], "v string")
    assert canonical_list.mapped(none, ref).count() == 0
    assert canonical_list.mapped(spark.createDataFrame([("x",)], "v string"), ref.limit(0)).count() == 0


def test_every_record_with_a_domain_has_one_row(spark, sf):
    found = queries.p3_found(spark, sf).collect()
    want = {r.tool_id for r in spark.read.parquet(f"{sf}/tools.parquet").collect() if r.domain and r.domain.strip()}
    assert {r.tool_id for r in found} == want and len(found) == len(want)


def test_short_and_long_values_are_read_whole(spark):
    """Values under four letters and over 256 are within the radius like any other; a blank is no value in either form."""
    long = "".join(chr(97 + i * i % 26) for i in range(300))
    ref = spark.createDataFrame([(1, "code", []), (2, long, []), (3, "data science", [])], "id long, name string, aliases array<string>")
    df = spark.createDataFrame([(v,) for v in ("cod", "cde", "codee", long[:-1], "da. s.", "co", " ", " ")], "v string")
    found = canonical_list.mapped(df, ref)
    assert {r.v: r.id for r in found.collect()} == {"cod": 1, "cde": 1, "codee": 1, long[:-1]: 2, "da. s.": 3}
    assert {r.v for r in canonical_list.unmatched(df, found).collect()} == {"co"}
