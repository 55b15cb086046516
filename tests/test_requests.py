import pytest
from pyspark.sql import functions as F

from callmetrics.operators import requests as rq


@pytest.mark.parametrize(("text", "forbids", "selects"), [
    ("Do not use get_file here", True, False), ("please use get-file", False, True), ("GET FILE should handle it", False, True), ("use get_file instead of get_file", True, False), ("nothing", False, False), (None, False, False),
])
def test_forbid_and_select(spark, text, forbids, selects):
    r, t = F.lit(text).cast("string"), F.lit("get_file")
    assert tuple(spark.range(1).select(rq.forbids(r, t), rq.selects(r, t)).first()) == (forbids, selects)


@pytest.mark.parametrize(("text", "reason"), [
    ("", "empty_request"), (None, "empty_request"), ("Explain, do not actually call it", "explanation_instead_of_action"), ("I do not know the path", None), ("I do not know it yet", "missing_required_information"),
    ("I only want a checklist.", "checklist_only"), ("X is unrelated to Y", "out_of_domain_request"), ("Read the file", None),
])
def test_abstention(spark, text, reason):
    assert spark.range(1).select(rq.abstention(F.lit(text).cast("string"))).first()[0] == reason
