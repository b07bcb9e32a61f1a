"""Images with brackets in their addresses; keys in deeply nested JSON."""

from pyspark.sql import functions as F

from cuemill.operators import articles


def images(spark, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = articles.extract_images(d).orderBy("id", "ordinal").collect()
    left = {r.id: r.image_marks_left for r in articles.replace_images(d).collect()}
    return [(r.id, r.alt, r.destination) for r in found], left


def test_nested_brackets_in_addresses(spark):
    four, eight = "a(b(c(d(e)f)g)h)i", "(" * 8 + "x" + ")" * 8
    found, left = images(
        spark, f"![one]({four}.png 'title') and ![two](<p (q.png>)", f"![]({eight})", f"![](({eight}))", r"![e](a\(b.png) \![no](x)", "![open](a(b.png", r"![m](a(\)(b)c).png)", "![b](a(one two)c)")
    assert found == [(0, "one", four + ".png"), (0, "two", "p (q.png"), (1, "", eight), (3, "e", r"a\(b.png"), (5, "m", r"a(\)(b)c).png"), (6, "b", "a(one two)c")]
    # Nine deep and an open bracket are not read, and are counted.
    assert left == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}


def test_long_addresses_and_open_brackets_end(spark):
    long = "data:image/png;base64," + "A(b)c" * 100_000
    found, left = images(spark, f"![{'alt ' * 50_000}]({long})", "![](" + "(" * 200_000, "![" * 2_000)
    assert [(i, len(a), d) for i, a, d in found] == [(0, 200_000, long)] and left[0] == 0


def test_forbidden_keys_in_very_deep_documents(spark):
    lists, objects = 20_000, 15_000
    texts = ["[" * lists + '{"style": 1}' + "]" * lists, '{"a":' * objects + '{"skin": {"theme": []}}' + "}" * objects, "[" * lists + "]" * (lists - 1), "[" * lists + '{"style" 1}' + "]" * lists]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {(r.id, r.path) for r in articles.forbidden_keys(d, "j").collect()}
    inside = "a." * objects + "skin"
    assert got == {(0, "[0]" * lists + ".style"), (1, inside), (1, inside + ".theme")}


def test_forbidden_keys_on_odd_documents(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "7"), (4, "[1, {\"x\": 2}"), (5, '{"style": {"style": [{"style": null}]}}')], "id int, j string")
    got = sorted((r.id, r.path) for r in articles.forbidden_keys(d, "j").collect())
    assert got == [(5, "style"), (5, "style.style"), (5, "style.style[0].style")]
    assert articles.forbidden_keys(d.where(F.lit(False)), "j").count() == 0
