from pyspark.sql import functions as F

from caretlake.operators import context as ctx

POSITIONS = [
    ("a\nbc\n", 1, 2, 4, "ok"),
    ("a\nbc\n", 1, 3, None, "past_eol"),
    ("a\r\nbc", 0, 1, 1, "ok"),
    ("a\r\nbc", 0, 2, None, "past_eol"),
    ("hé😀x", 0, 3, 3, "ok"),
    ("ab", 0, 2, 2, "ok"),
    ("ab", 0, 3, None, "past_eol"),
    ("ab", 0, 0, 0, "ok"),
    ("a\nb", 1, 0, 2, "ok"),
    ("", 0, 1, None, "past_eol"),
    ("a\nb\n", 2, 1, None, "past_eol"),
    ("a\nb\n", 2, 0, 4, "ok"),
    ("a\nb\n", 3, 1, None, "no_such_line"),
    ("a\nb", 5, 1, None, "no_such_line"),
    ("ab", -1, 1, None, "invalid_position"),
    ("ab", 0, -1, None, "invalid_position"),
]


def test_positions(spark):
    df = spark.createDataFrame([(i, t, l, c) for i, (t, l, c, _, _) in enumerate(POSITIONS)],
                               "i int, text string, line int, ch int")
    got = {r.i: (r.pos, r.status) for r in ctx.resolve_position(df).collect()}
    assert got == {i: (p, s) for i, (_, _, _, p, s) in enumerate(POSITIONS)}


def test_windows(spark):
    cases = [("abc", 1, 128, "a", "c"), ("abc", 3, 128, "abc", ""), ("abc", 2, 128, "ab", ""),
             ("abcdefgh", 4, 2, "cd", "f"), ("abcdefgh", 4, 1, "d", ""),
             ("x" * 300, 150, 128, "x" * 128, "x" * 127)]
    for text, pos, window, prefix, suffix in cases:
        df = spark.createDataFrame([(text, pos)], "text string, pos int")
        row = ctx.context_window(df, window=window).first()
        assert (row.prefix, row.suffix) == (prefix, suffix)


def test_unresolved_cursor_has_no_context(spark):
    row = ctx.context_window(spark.createDataFrame([("abc", None)], "text string, pos int")).first()
    assert row.prefix is None and row.suffix is None


def test_mask_already_in_context(spark):
    df = spark.createDataFrame([("a<mask>", "b", "ok"), ("a", "b", "ok"), ("a", "<mask>", "past_eol")],
                               "prefix string, suffix string, status string")
    rows = ctx.mask_prompt(df).collect()
    assert [r.status for r in rows] == ["ambiguous_mask", "ok", "past_eol"]
    assert rows[1].prompt == "a<mask>b"


def _lines(text):
    out, start = [], 0
    for no, line in enumerate(text.split("\n")):
        out.append((no, start, line))
        start += len(line) + 1
    return out


def test_line_index_against_python(spark):
    texts = ["", "a", "\n", "a\n\nb\n", "hé\n😀x", "\n".join(str(i) for i in range(5000))]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "uri string, text string")
    got = sorted((r.uri, r.line_no, r.start, r.line) for r in ctx.line_index(df).collect())
    assert got == sorted((str(i), *row) for i, t in enumerate(texts) for row in _lines(t))


def test_round_trip(spark, documents):
    """A position inside a line resolves to the line's start plus the column."""
    lines = ctx.line_index(documents, "doc_id").filter(F.length("line") > 0)
    cursors = lines.withColumn("ch", F.greatest(F.lit(1), F.length("line") - 1)).withColumnRenamed(
        "line", "line_text").withColumn("line", F.col("line_no").cast("int"))
    df = ctx.resolve_position(cursors.join(documents.select("doc_id", "text"), "doc_id"))
    assert df.filter((F.col("status") != "ok") | (F.col("pos") != F.col("start") + F.col("ch"))).count() == 0
    cut = ctx.context_window(df)
    whole = F.concat("prefix", F.substr("text", F.col("pos") + 1, F.lit(1)), "suffix")
    assert cut.filter(~F.contains("text", whole)).count() == 0


def test_cloze_every_place_once(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, ""), (3, "a b c d")], "doc_id long, text string")
    chars = ctx.cloze_prompts(df).filter("doc_id = 1").orderBy("pos").collect()
    assert [(r.prefix, r.target, r.suffix) for r in chars] == [
        ("", "a", "bcd"), ("a", "b", "cd"), ("ab", "c", "d"), ("abc", "d", "")]
    words = ctx.cloze_prompts(df, unit="word").orderBy("pos").collect()
    assert [(r.doc_id, r.prefix, r.target, r.suffix) for r in words] == [
        (3, "a", "b", "c d"), (3, "a b", "c", "d")]


def test_cloze_word_window(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(9)))], "doc_id long, text string")
    row = ctx.cloze_prompts(df, unit="word", window=2).filter("pos = 4").first()
    assert (row.prefix, row.target, row.suffix) == ("w2 w3", "w4", "w5 w6")


def test_unknown_document(spark):
    cursors = spark.createDataFrame([("a",), ("b",)], "uri string")
    docs = spark.createDataFrame([("a", "text")], "uri string, text string")
    got = {r.uri: r.status for r in ctx.attach_documents(cursors, docs).collect()}
    assert got == {"a": "ok", "b": "unknown_document"}


def test_a_document_without_text_is_unknown(spark):
    df = spark.createDataFrame([(None, 0, 1)], "text string, line int, ch int")
    row = ctx.resolve_position(df).first()
    assert (row.status, row.pos) == ("unknown_document", None)


def test_places_and_their_contexts(spark):
    docs = spark.createDataFrame([(1, "a b, c d e"), (2, "x y"), (3, None), (4, ""), (5, "p q r")],
                                 "doc_id int, text string")
    places = ctx.cloze_places(docs)
    assert sorted(map(tuple, places.collect())) == [(1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (5, 1, "q")]
    more = places.unionByName(spark.createDataFrame([(1, 4, "e"), (9, 1, "?")], places.schema))
    cut = {(r.doc_id, r.pos): (r.prefix, r.suffix) for r in ctx.cut_contexts(more, docs, 2).collect()}
    assert cut == {(1, 1): ("a", "c d"), (1, 2): ("a b", "d e"), (1, 3): ("b c", "e"), (5, 1): ("p", "r"),
                   (1, 4): (None, None), (9, 1): (None, None)}


def test_places_are_as_long_as_the_text(spark):
    """Four times the words make four times the places; whole contexts would make sixteen."""
    def size(df):
        return sum(len(str(tuple(r))) for r in df.collect())

    def places(n):
        return ctx.cloze_places(spark.createDataFrame([(1, "word " * n)], "doc_id int, text string"))

    assert size(places(4000)) < 4.5 * size(places(1000))
