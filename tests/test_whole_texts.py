"""Queries over whole texts against plain Python, on texts with NULs, entities, long runs and wide rows past the prefixes."""

from lamina import plans


def test_null_strip_of_whole_texts(spark, tmp_path):
    head = "x" * 60
    rows = [(1, head + "\0a&ns_ai;\0", "s"), (2, head + "adobe-blending-mode: SoftLight;\0", "s"), (3, "short", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.nulls, r.xml) for r in plans.queries()["null_strip"](spark, str(tmp_path)).collect()}
    ns, tail = "http://ns.adobe.com/AdobeIllustrator/10.0/", "mix-blend-mode:color-burn;s"
    assert got == {1: (4, f"{head}a{ns}{ns}{tail}"), 2: (3, f"{head}mix-blend-mode:soft-light;{ns}{tail}"), 3: (2, f"short{ns}{tail}")}


def test_runs_and_grid_of_whole_texts(spark, tmp_path):
    texts = ["a " * 20 + "\U0001f600", "", "one two  three " * 5]
    spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    runs = {r.turn: (r.run_start, r.run_end) for r in plans.queries()["text_runs"](spark, str(tmp_path)).collect()}
    assert runs == {0: (0, 42), 1: (42, 43), 2: (43, 43 + len(texts[2]))}  # a line end belongs to the run before it
    cells = sorted((r.row, r.col, r.x, r.y, r.has_text) for r in plans.queries()["table_grid"](spark, str(tmp_path)).collect())
    words = [t.split(" ") for t in texts]
    cols = max(map(len, words))
    assert cells == [(i, j, j * (960.0 / cols), i * (540.0 / 3), w != "") for i, ws in enumerate(words) for j, w in enumerate(ws)]


def test_all_styles_are_dealt(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(30)], "item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, t) for t in range(12)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.item_id for r in plans.queries()["positional_zip"](spark, str(tmp_path)).collect()}
    assert got == {t: 3 * min(t, 9) for t in range(12)}
