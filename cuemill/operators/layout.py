"""Cards on screen: text weight, estimated height, chapter totals, style routing, sampled times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions import rules, text


def _items_width(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + text.display_width(x, 50))


def text_weight(type_, label, title, body, items, source_name=None, source_note=None) -> Column:
    """Text weight of a card state; formula counts its parts only, lists count no items."""
    t = F.col(type_)
    w = lambda c: text.display_width(c, 50)
    named = F.lit("")
    for k, v in rules.TYPE_LABELS.items():
        named = F.when(t == k, F.lit(v)).otherwise(named)
    lab = w(F.when(F.coalesce(F.col(label), F.lit("")) != "", F.col(label)).otherwise(named))
    inner = _items_width(F.col(items))
    blank = F.lit("")
    name = F.when(F.coalesce(F.col(source_name), blank) != "", F.col(source_name)).otherwise(F.col(body)) if source_name else F.col(body)
    note = F.col(source_note) if source_note else blank
    return (
        F.when(t == "formula", inner).when(t.isin("progressive-list", "path"), lab + w(title)).when(t == "relation", lab + w(title) + inner)
        .when(t == "quote", w(title) + w(name) + w(note)).when(t == "thesis", lab + w(title) + w(body) + inner).otherwise(lab + w(title) + w(body)))


def relation_rows(layout, n) -> Column:
    """Items per row: a table for 5 to 12 items of the multi-item layout, else one row."""
    out = F.when(F.col(n) <= 0, F.array().cast("array<int>")).when(F.col(layout) != "multi-item", F.array(F.col(n).cast("int")))
    for k, v in rules.ROW_DISTRIBUTIONS.items():
        out = out.when(F.col(n) == k, F.array(*[F.lit(x) for x in v]))
    return out.otherwise(F.array(F.col(n).cast("int")))


def state_height(first_visual: Column) -> Column:
    """Estimated height from columns type, card_size, title, body, items, relation_layout, source_note."""
    t, small = F.col("type"), F.col("card_size") == "small"
    lines = lambda c, few, many: F.when(small, text.wrapped_lines(c, few)).otherwise(text.wrapped_lines(c, many))
    n = F.size("items")
    body = lines("body", 16, 19)
    item_rows = F.greatest(F.lit(1), F.ceil(_items_width(F.col("items")) / 20.0))
    thesis = F.lit(108) + F.greatest(F.lit(1), lines("title", 10, 12)) * 67 + F.when(body > 0, body * 54 + 10).otherwise(0) + F.when(
        n > 0, item_rows * 68 + (item_rows - 1) * 16 + 28).otherwise(0)
    quote = F.greatest(F.lit(1), lines("title", 9, 11)) * 104 + 288 + text.wrapped_lines("source_note", 18) * 34
    rows = F.size("__rows")
    content = F.when(F.col("relation_layout") == "hierarchy", 176).otherwise(F.greatest(F.lit(1), rows) * 76 + F.greatest(F.lit(0), rows - 1) * 14)
    relation = F.greatest(F.lit(1), text.wrapped_lines("title", 17)) * 43 + 107 + content
    listed = F.when(n > 0, 20).otherwise(0) + n * 104 + F.greatest(F.lit(0), n - 1) * 16 + 150
    chat = F.greatest(F.lit(76), text.wrapped_lines("body", 18) * 46 + 48) + n * 74 + 112
    return (
        F.when(t == "thesis", thesis).when(t == "quote", quote).when(t == "comparison", 162).when(t == "formula", F.when(first_visual, 172).otherwise(120))
        .when(t == "relation", relation).when(t.isin("progressive-list", "path"), listed).when(t == "chat", chat).otherwise(220).cast("long"))


def state_heights(states: DataFrame, key: str = "media_id", chapter: str = "chapter_id", pos: str = "pos") -> DataFrame:
    """Height of each visible state (action enter or update); the first of a chapter counts as first visual."""
    shown = states.filter(F.col("action").isin("enter", "update")).withColumn("__n_items", F.size("items"))
    first = shown.groupBy(key, chapter).agg(F.min(pos).alias("__first"))
    s = shown.join(first, [key, chapter]).withColumn("__rows", relation_rows("relation_layout", "__n_items"))
    return s.withColumn("height", state_height(F.col(pos) == F.col("__first"))).drop("__first", "__rows", "__n_items")


def card_layout(states: DataFrame, key: str = "media_id", chapter: str = "chapter_id", pos: str = "pos") -> DataFrame:
    """Chapter height with the normal and the compact gap, against the budget."""
    g = state_heights(states, key, chapter, pos).groupBy(key, chapter).agg(F.sum("height").alias("__h"), F.count(F.lit(1)).alias("states"))
    total = lambda gap: F.col("__h") + (F.col("states") - 1) * gap
    g = g.withColumn("height", total(rules.LAYER_GAP)).withColumn("compact_height", total(rules.COMPACT_GAP)).drop("__h")
    return g.withColumn("fits", F.col("height") <= rules.STAGE_BUDGET).withColumn("fits_compact", F.col("compact_height") <= rules.STAGE_BUDGET)


def _of(table: dict, key: Column) -> Column:
    """Value of a small dictionary, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)


def check_cards(states: DataFrame) -> DataFrame:
    """Chosen size, structure, layout, reasons and connectors of every card state against the card policy.

    Reads type, card_size, content_structure, size_reason, relation_layout, layout_reason, fidelity_mode, label, title, body,
    parts (array of strings), items (array of structs text, incoming), connector, source_name, source_note; nulls count as
    empty. Adds ``text_weight`` (null if the size is unknown: then that is the only error), ``card_errors``
    (array of rule, item_no from 1 or null, actual) and ``ok``. All of it is worked out in the row: no shuffle."""
    said = lambda c: text.clean_ends(c)
    kind, size, form = F.coalesce("type", F.lit("")), said("card_size"), said("relation_layout")
    sizes, fewest, most = ({k: v[i] for k, v in rules.CARD_LAYOUTS.items()} for i in range(3))
    items = F.coalesce("items", F.array().cast(states.schema["items"].dataType))
    parts = F.coalesce("parts", F.array().cast("array<string>"))
    s = states.withColumn("__said", F.when(kind == "formula", parts).otherwise(F.transform(items, lambda x: F.coalesce(x["text"], F.lit("")))))
    weight = text_weight("type", "label", "title", "body", "__said", "source_name", "source_note")
    known, related = form.isin(*rules.CARD_LAYOUTS), kind == "relation"
    small_ok = form.isin(*[k for k, v in sizes.items() if "small" in v])
    fits_type = F.lit(False)
    for k, v in rules.TYPE_LAYOUTS.items():
        fits_type = F.when(kind == k, form.isin(*v)).otherwise(fits_type)
    n = F.size(items)
    thin = lambda c: text.display_width(said(c), 50) < rules.REASON_WIDTH
    none = F.lit(None).cast("string")
    checks = [
        ("content_structure_invalid_or_missing", ~said("content_structure").isin(*rules.CARD_STRUCTURES), said("content_structure")),
        ("card_size_reason_missing", thin("size_reason"), none),
        ("spoken_first_fidelity_missing", said("fidelity_mode") != rules.FIDELITY_MODE, said("fidelity_mode")),
        ("relation_layout_invalid_or_missing", ~known, form),
        ("layout_reason_missing", thin("layout_reason"), none),
        ("card_text_exceeds_selected_size", weight > F.coalesce(_of(rules.LAYOUT_WEIGHTS, form), _of(rules.CARD_WEIGHTS, size)), weight),
        ("relation_layout_not_allowed_for_type", known & ~fits_type, form),
        ("card_size_not_allowed_for_relation_layout", known & (size == "small") & ~small_ok, size),
        ("relation_item_count_invalid", related & known & ~n.between(_of(fewest, form), _of(most, form)), n),
        ("relation_global_connector_forbidden", related & known & F.col("connector").isNotNull(), F.col("connector")),
        ("formula_relation_layout_invalid", (kind == "formula") & (form != "formula"), form),
    ]
    error = lambda rule, at, actual: F.struct(rule.alias("rule"), at.cast("int").alias("item_no"), actual.cast("string").alias("actual"))
    whole = F.array_compact(F.array(*[F.when(bad, error(F.lit(rule), F.lit(None), actual)) for rule, bad, actual in checks]))

    def joint(x: Column, i: Column) -> Column:
        mark = said(x["incoming"])
        rule = F.when(form.isin(*rules.CONNECTED_LAYOUTS), F.when((i == 0) & (mark != ""), "relation_first_item_connector_forbidden").when(
            (i > 0) & ~mark.isin(*rules.CONNECTORS), "relation_incoming_connector_missing_or_invalid")).when(mark != "", "relation_connector_not_allowed_for_layout")
        return F.when(x.isNotNull() & rule.isNotNull(), error(rule, i + 1, mark))

    joints = F.when(related & known, F.array_compact(F.transform(items, joint)))
    unsized = F.array(error(F.lit("card_size_invalid_or_missing"), F.lit(None), size))
    sized = size.isin(*rules.CARD_WEIGHTS)
    s = s.withColumn("card_errors", F.when(sized, F.concat(whole, F.coalesce(joints, F.slice(whole, 1, 0)))).otherwise(unsized))
    return s.withColumn("text_weight", F.when(sized, weight)).withColumn("ok", F.size("card_errors") == 0).drop("__said")


def card_findings(states: DataFrame, media: str = "media_id", subject: str = "pos") -> DataFrame:
    """Errors of ``check_cards`` in the findings schema; ``detail`` holds item (from 1) and actual."""
    f = check_cards(states).select(F.col(media).alias("media_id"), F.col(subject).cast("string").alias("subject_id"), F.explode("card_errors").alias("e"))
    detail = F.map_filter(F.create_map(F.lit("item"), F.col("e.item_no").cast("string"), F.lit("actual"), F.col("e.actual")), lambda k, v: v.isNotNull())
    return f.select("media_id", "e.rule", F.lit("error").alias("severity"), "subject_id", detail.alias("detail"))


def route(inputs: DataFrame, routes: dict, default: str, threshold: float = 0.75, manual_only=()) -> DataFrame:
    """Style per input (user_style, profile, confidence, user_confirmed, user_reason): the user's choice, else the profile's
    route when sure enough, else the default. ``routes`` is a small dictionary, so it becomes an expression."""
    user = F.coalesce(text.clean_ends("user_style"), F.lit(""))
    routed = F.lit(None).cast("string")
    for profile, style in routes.items():
        routed = F.when(F.col("profile") == profile, F.lit(style)).otherwise(routed)
    sure = F.col("confidence") >= threshold
    style = F.when(user != "", user).when(F.col("profile").isNotNull() & sure & routed.isNotNull(), routed).otherwise(F.lit(default))
    source = F.when(user != "", "user_override").when(F.col("profile").isNotNull() & sure & routed.isNotNull(), "ai_routing").otherwise("default_fallback")
    out = inputs.withColumn("style", style).withColumn("source", source)
    manual = F.col("style").isin(*manual_only) if manual_only else F.lit(False)
    problem = (
        F.when((user == "") & F.col("profile").isNotNull() & routed.isNull(), "unknown_profile")
        .when((user == "") & F.col("profile").isNotNull() & (F.col("confidence").isNull() | ~F.col("confidence").between(0, 1)), "bad_confidence")
        .when(manual & (F.col("source") != "user_override"), "manual_only")
        .when(manual & ~(F.coalesce("user_confirmed", F.lit(False)) & (text.clean_ends("user_reason") != "")), "needs_confirmation"))
    return out.withColumn("problem", problem)


def check_limits(texts: DataFrame, limits: DataFrame, column: str, on: str) -> DataFrame:
    """Length of each text against its field's minimum and maximum. ``limits`` is a small table of one row per field."""
    j = texts.join(limits, on, "left")
    n = F.length(F.coalesce(F.col(column), F.lit(""))).cast("long")
    low, high = F.coalesce(n >= F.col("minimum"), F.lit(True)), F.coalesce(n <= F.col("maximum"), F.lit(True))
    none = F.col("minimum").isNull() & F.col("maximum").isNull()
    return j.withColumn("characters", n).withColumn("within_range", F.when(~none, low & high)).withColumn("margin", F.col("maximum") - n)


def thin(points: DataFrame, most: int, key: str = "media_id", value: str = "at_ms") -> DataFrame:
    """At most ``most`` of the sorted distinct points of each key, evenly spread. Each point asks, by its own rank, whether it
    is one of the chosen: the rank r is chosen when round(i * (n - 1) / (most - 1)) = r for some i (halves to even)."""
    from cuemill.operators import scans

    d = points.select(key, value).distinct()
    n = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    r = scans.ordinals(d, key, value, scans.by_span(value, 600_000), "rank").join(n, key)
    step = (F.col("n") - 1) / F.lit(float(most - 1))
    guess = F.floor(F.col("rank") / step).cast("long")
    picks = lambda i: (i >= 0) & (i < most) & (F.bround(i * step, 0).cast("long") == F.col("rank"))
    chosen = picks(guess) | picks(guess + 1) | picks(guess - 1)
    return r.filter((F.col("n") <= most) | chosen).select(key, value, "rank", "n")
