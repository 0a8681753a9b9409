"""Each rule of record streams with a line that breaks it."""

import json

import pytest

from paperloom.sources.record_rules import KEYS, record_defects

PAGE = {"kind": "page", "schema_version": 1, "page_index": 0, "media_box": [0, 0, 100, 200], "crop_box": [0.0, 0.0, 100.0, 200.0], "rotation": 0, "width": 100, "height": 200, "transform": [1, 0, 0, -1, 0, 200]}
BLOCK = {"kind": "block", "schema_version": 1, "page_index": 0, "ordinal": 0, "box": [10, 10, 30, 20], "block_type": "text", "font_size": 9.5, "bold": False, "source_group": 0}
SPAN = {"kind": "span", "schema_version": 1, "page_index": 0, "ordinal": 0, "block_ordinal": 0, "raw_text": "a😀", "character_boxes": [[10, 10, 20, 20], [20, 10, 30, 20]]}
IMAGE = BLOCK | {"ordinal": 1, "block_type": "image", "source_group": 1}
SECOND = PAGE | {"page_index": 1, "rotation": 90}
NEXT = BLOCK | {"page_index": 1, "ordinal": 2}
LAST = SPAN | {"page_index": 1, "ordinal": 1, "block_ordinal": 2}
END = {"kind": "summary", "schema_version": 1, "page_count": 2, "block_count": 3, "span_count": 2, "character_count": 4}
GOOD = [PAGE, BLOCK, SPAN, IMAGE, SECOND, NEXT, LAST, END]


def swap(i, **new):
    return [r | new if k == i else r for k, r in enumerate(GOOD)]


CASES = {
    "good": (GOOD, set()),
    "malformed": ([*GOOD[:3], "nope", *GOOD[3:]], {"malformed"}),
    "twice": ([*GOOD[:3], '{"kind":"page","kind":"page"}', *GOOD[3:]], {"malformed"}),
    "array": ([*GOOD[:3], "[1]", *GOOD[3:]], {"malformed"}),
    "null": ([*GOOD[:3], None, *GOOD[3:]], {"malformed"}),
    "unknown kind": ([*GOOD[:3], {"kind": "line"}, *GOOD[3:]], {"malformed"}),
    "extra key": (swap(3, more=1), {"keys"}),
    "missing key": ([{k: v for k, v in r.items() if k != "bold"} if r is IMAGE else r for r in GOOD], {"keys"}),
    "version": (swap(3, schema_version=2), {"version"}),
    "version type": (swap(3, schema_version=1.0), {"version"}),
    "boolean number": (swap(3, source_group=True), {"types"}),
    "text number": (swap(3, font_size="9"), {"types"}),
    "bold": (swap(3, bold=1), {"types"}),
    "null box": (swap(3, box=None), {"types"}),
    "negative": (swap(3, ordinal=-1), {"types"}),
    "box turned": (swap(3, box=[30, 10, 10, 20]), {"geometry"}),
    "box of three": (swap(3, box=[1, 2, 3]), {"geometry"}),
    "box off page": (swap(3, box=[10, 10, 101, 20]), {"geometry"}),
    "crop beyond media": (swap(4, media_box=[0, 0, 100, 190]), {"geometry"}),
    "rotation": (swap(4, rotation=45), {"geometry"}),
    "flat": (swap(4, transform=[1, 1, 1, 1, 0, 0]), {"geometry"}),
    "turned over": (swap(4, transform=[-1, 0, 0, -1, 100, 200]), {"geometry"}),
    "block type": (swap(3, block_type="other"), {"geometry", "no_text"}),
    "not filled": (swap(6, character_boxes=[[10, 10, 20, 20], [20, 10, 29, 20]]), {"geometry"}),
    "beyond block": (swap(6, character_boxes=[[10, 10, 20, 20], [20, 10, 31, 20]]), {"geometry"}),
    "one box": (swap(6, character_boxes=[[10, 10, 30, 20]]), {"text"}),
    "nul": (swap(6, raw_text="a\0"), {"text"}),
    "empty": (swap(6, raw_text="", character_boxes=[]), {"text", "summary"}),
    "page number": (swap(4, page_index=2), {"order"}),
    "group jump": (swap(3, source_group=2), {"order"}),
    "group from 1": (swap(5, source_group=2), {"order"}),
    "block number": (swap(3, ordinal=5), {"order"}),
    "wrong block": (swap(6, block_ordinal=1), {"order"}),
    "no text": ([r for r in GOOD if r is not LAST], {"no_text", "summary"}),
    "two spans": ([*GOOD[:7], LAST | {"ordinal": 2}, END | {"span_count": 3, "character_count": 6}], {"order"}),
    "span in image": ([*GOOD[:4], SPAN | {"ordinal": 1, "block_ordinal": 1}, *GOOD[4:6], LAST | {"ordinal": 2}, END | {"span_count": 3, "character_count": 6}], {"order"}),
    "block first": ([BLOCK, *GOOD[1:]], {"order", "geometry", "summary"}),
    "no summary": (GOOD[:-1], {"summary"}),
    "counts": (swap(7, character_count=5), {"summary"}),
    "after summary": ([*GOOD, END], {"summary"}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i, r if r is None or isinstance(r, str) else json.dumps(r)) for name, (records, _) in CASES.items() for i, r in enumerate(records)]
    out = {}
    for r in record_defects(spark.createDataFrame(rows, "doc string, number int, line string").repartition(3)).collect():
        out.setdefault(r.doc, {})[r.rule] = (r.n, r.first)
    return out


@pytest.mark.parametrize("name", CASES)
def test_rule(found, name):
    assert set(found.get(name, {})) >= CASES[name][1] if name == "block first" else set(found.get(name, {})) == CASES[name][1]


def test_counts(found):
    assert found["malformed"]["malformed"] == (1, 3) and found["no summary"]["summary"] == (1, 6) and found["after summary"]["summary"][1] == 8


def test_the_rest_of_a_document_is_not_lost_behind_odd_lines(spark):
    """Lines between a block and its span that are no block, page or span, a malformed line behind the summary, fields that are read in another kind only, a number above 64 bits, two documents with equal numbers."""
    rows = [*GOOD[:2], "nope", {"kind": "other"}, *GOOD[2:], "nope"]
    big = swap(7, character_count=2**70)
    foreign = [r | {"box": "x", "page_count": -1, "media_box": 1} if r is SPAN else r for r in GOOD]
    table = [(d, i, r if isinstance(r, str) else json.dumps(r)) for d, rs in (("a", rows), ("b", big), ("c", foreign), ("d", [SPAN, *GOOD])) for i, r in enumerate(rs)]
    got = {}
    for r in record_defects(spark.createDataFrame(table, "doc string, number int, line string").repartition(3)).collect():
        got.setdefault(r.doc, {})[r.rule] = (r.n, r.first)
    assert got["a"] == {"malformed": (3, 2), "summary": (1, 10)} and got["b"] == {"types": (1, 7)} and got["c"] == {"keys": (1, 2)}
    assert got["d"] == {"order": (3, 0), "summary": (1, 8)}


def test_all_windows_have_one_order(spark, data):
    """Lines are sorted once: a sort for each window was most of the time."""
    from paperloom.plans import rules

    plan = rules.record_defects(spark, data)._jdf.queryExecution().sparkPlan().toString().split("Generate explode")[1].split("Generate inline")[0]
    assert plan.count("Window [") == 1


def test_nothing(spark):
    assert record_defects(spark.createDataFrame([], "doc string, number int, line string")).collect() == []
    assert set(KEYS) == {"page", "block", "span", "summary"}


def test_the_query_looks_at_lines_in_all_tasks(spark, data):
    """Lines are many times as large as the rows they are made of: tasks that adaptive execution leaves for the rows are too few."""
    from paperloom.plans import rules

    out = rules.record_defects(spark, data)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.split("Generate inline")[1:] if "Exchange" in x]
    assert made and all(x[x.index("Exchange") :].partition("\n")[0].count("REPARTITION_BY_NUM") for x in made)
