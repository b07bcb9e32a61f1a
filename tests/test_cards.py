"""The card policy on literal states."""

from cuemill.operators import findings, layout

STATE = (
    "media_id string, pos int, type string, card_size string, content_structure string, size_reason string, relation_layout string, layout_reason string, fidelity_mode string, label string, title string, "
    "body string, parts array<string>, items array<struct<text string, incoming string>>, connector string, source_name string, source_note string"
)
FIELDS = [f.split()[0] for f in STATE.split(", ") if not f.startswith("incoming")]
GOOD = dict(
    media_id="m", type="thesis", card_size="medium", content_structure="core-idea", size_reason="一个核心观点用中卡", relation_layout="single-point", layout_reason="原话只有一个核心观点",
    fidelity_mode="spoken-first", title="核心观点", body="一行解释")
RELATED = dict(type="relation", content_structure="horizontal-relation", relation_layout="narrative-path", title="素材流程", body=None)


def errors(spark, *changes):
    rows = [tuple(({**GOOD, **c, "pos": i}).get(f) for f in FIELDS) for i, c in enumerate(changes)]
    found = layout.check_cards(spark.createDataFrame(rows, STATE)).orderBy("pos").collect()
    return [[(e.rule, e.item_no) for e in r.card_errors] for r in found], [r.text_weight for r in found]


def path(*marks):
    return {**RELATED, "items": [(f"步骤{i}", m) for i, m in enumerate(marks)]}


def test_valid_cards(spark):
    ten = {**RELATED, "relation_layout": "multi-item", "content_structure": "balanced-grid", "items": [(f"第{i}项", None) for i in range(1, 11)]}
    found, weights = errors(spark, {}, path(None, "→", "→", " ⇒ "), ten, {"card_size": " small ", "items": []})
    assert found == [[], [], [], []]
    # "KEY IDEA" is 4 wide, title and body 4 each; ten items of 2.5 and one of 3 for the two digits.
    assert weights == [12.0, 6.0 + 4 + 4 * 2.5, 6.0 + 4 + 9 * 2.5 + 3, 12.0]


def test_unknown_size_is_the_only_error(spark):
    found, weights = errors(spark, {"card_size": "large", "relation_layout": "x"}, {"card_size": None})
    assert found == [[("card_size_invalid_or_missing", None)]] * 2 and weights == [None, None]


def test_reasons_structure_and_mode(spark):
    found, _ = errors(
        spark, {"size_reason": "short one", "layout_reason": None}, {"content_structure": None, "fidelity_mode": "formal"}, {"relation_layout": "circle"}, {"size_reason": "sixteen letters."})
    assert found == [
        [("card_size_reason_missing", None), ("layout_reason_missing", None)], [("content_structure_invalid_or_missing", None), ("spoken_first_fidelity_missing", None)],
        [("relation_layout_invalid_or_missing", None)], []]


def test_text_too_long_for_the_size(spark):
    body = "长" * 60
    found, _ = errors(spark, {"body": body}, {"body": body + "长" * 5}, {"body": "长" * 21, "card_size": "small"}, {"body": "长" * 20, "card_size": "small"}, {"type": "formula", "relation_layout": "formula", "parts": ["长" * 73], "body": None})
    over = [("card_text_exceeds_selected_size", None)]
    assert found == [[], over, over, [], over]


def test_layouts_by_type_size_and_items(spark):
    five = {**RELATED, "relation_layout": "parallel", "items": [(str(i), None) for i in range(5)]}
    found, _ = errors(
        spark, five, {"relation_layout": "quote"}, {**path(None, "→"), "card_size": "small"}, {"type": "formula", "relation_layout": "quote", "parts": []}, {**path(None, "→"), "connector": ""}, {"type": None}, {**RELATED, "items": None})
    count, kind = ("relation_item_count_invalid", None), ("relation_layout_not_allowed_for_type", None)
    assert found == [[count], [kind], [("card_size_not_allowed_for_relation_layout", None)], [kind, ("formula_relation_layout_invalid", None)], [("relation_global_connector_forbidden", None)], [kind], [count]]


def test_connectors(spark):
    plain = {**RELATED, "relation_layout": "parallel", "items": [("a", ""), ("b", "→"), None]}
    found, _ = errors(spark, path("→", "→"), path(None, None, "->"), plain)
    missing = "relation_incoming_connector_missing_or_invalid"
    assert found == [[("relation_first_item_connector_forbidden", 1)], [(missing, 2), (missing, 3)], [("relation_connector_not_allowed_for_layout", 2)]]


def test_findings_and_verdict(spark):
    rows = [tuple(({**GOOD, **c}).get(f) for f in FIELDS) for c in ({"pos": 1}, {"pos": 2, "media_id": "n", **path("→", "→")})]
    states = spark.createDataFrame(rows, STATE)
    f = layout.card_findings(states)
    assert [(r.media_id, r.subject_id, r.severity, r.detail) for r in f.collect()] == [("n", "2", "error", {"item": "1", "actual": "→"})]
    assert {r.media_id: r.ok for r in findings.verdict(f, states).collect()} == {"m": True, "n": False}
    assert layout.card_findings(states.limit(0)).count() == 0


def test_work_stays_in_the_row(spark):
    rows = [tuple({**GOOD, "pos": 1}.get(f) for f in FIELDS)]
    plan = layout.card_findings(spark.createDataFrame(rows, STATE))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
