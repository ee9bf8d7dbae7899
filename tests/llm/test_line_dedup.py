from __future__ import annotations

import pyspark.sql.functions as F

from plumbline.llm.line_dedup import _end, dedup_lines, op10_line_dedup

SMALL = "/root/testdata/sf0.01"


def one_edit_away(a: list[str], b: list[str]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def brute(docs: list[tuple], least: int = 5) -> dict:
    """doc_id -> removed places, by comparing each line with all distinct earlier ones of nearly its length."""
    lines = [((d is not None, d or 0), at, tuple((x.encode()).split())) for d, t in docs for at, x in enumerate((t or "").split("\n"))]
    first: dict = {}
    for d, at, w in lines:
        if len(w) >= least:
            first[w] = min(first.get(w, (d, at)), (d, at))
    by_len: dict = {}
    for w, place in first.items():
        by_len.setdefault(len(w), []).append((w, place))
    near = {}
    for w, place in first.items():
        near[w] = any(p < place and one_edit_away(w, v) for n in (len(w) - 1, len(w), len(w) + 1) for v, p in by_len.get(n, []))
    gone: dict = {}
    for d, at, w in lines:
        if len(w) >= least and (first[w] < (d, at) or near[w]):
            gone.setdefault(d[1] if d[0] else None, set()).add(at)
    return gone


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    for d, t in rows:
        lines, gone = (t or "").split("\n"), want.get(d, set())
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t
        assert got[d]["text"] == kept and got[d]["n_removed"] == len(gone) and got[d]["n_lines"] == len(lines)


def test_edits_ties_and_empties(spark):
    base = "one two three four five six seven"
    rows = [(None, base), (1, base + "\n" + base), (2, None), (3, ""), (4, "\n\n"), (5, base.replace("four", "4") + "\n  one two\tthree four five six seven "),
            (6, base.replace("four ", "")), (7, base + " eight"), (8, "zero " + base), (9, "a b c d"), (10, "a b c d"), (11, "one two three 4 five six 7"), (12, "x " * 3000), (13, "x " * 3001), (14, "x " * 3003)]
    check(spark, rows)


def test_many_replacements_in_one_place(spark):
    check(spark, [(k, f"the same line but word w{k} differs here") for k in range(40, 0, -1)] + [(100, "the same line but word differs here")])


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r["doc_id"]: r["n_removed"] for r in op10_line_dedup(spark, SMALL).collect()}
    assert got == {d: len(want.get(d, ())) for d, _ in rows} and sum(got.values()) > 50


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e\na b c d e", "x", 5)], "doc_id long, text string, _id string, n_lines int")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "_id", "n_lines", "n_removed"] and out.first()["text"] == "a b c d e"
    assert dedup_lines(docs.where("doc_id < 0")).count() == 0


def test_ends_fit_twice_for_neighbouring_lengths(spark):
    for r in spark.range(4, 3000).select("id", _end(F.col("id").cast("int")).alias("p"), _end(F.col("id").cast("int") + 1).alias("q")).collect():
        assert 2 <= r["p"] and 2 * r["p"] <= r["id"] and r["p"] * 3 > r["id"] - 1 and r["q"] >= r["p"]


def test_short_lines_that_repeat_go_where_asked(spark):
    import corpus_pipeline as P

    rows = [(1, "And so.\n\none two three four five"), (2, "And  so.\n \nAnd now."), (3, "so\nAnd so.\nAnd then.\none two three 4 five"), (4, "so")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: rows[0][1], 2: " \nAnd now.", 3: "so\nAnd then.", 4: ""}
    assert {r["doc_id"]: r["text"] for r in P.drop_lines(spark, docs, "").collect()} == want
    assert {r["doc_id"]: r["n_removed"] for r in dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    long = brute([tuple(r) for r in docs.collect()])
    lines = [((d, at), b" ".join(x.split())) for d, t in sorted(map(tuple, docs.collect())) for at, x in enumerate((t or "").encode().split(b"\n"))]
    seen, short = set(), 0
    for _, x in lines:
        short += 0 < len(x.split()) < 5 and x in seen
        seen.add(x)
    got = dedup_lines(docs, equal_words=1).agg(F.sum("n_removed")).first()[0]
    assert short > 0 and got == short + sum(map(len, long.values()))


def test_rows_of_one_id_with_different_texts(spark):
    lines = [f"line number {k} has words of its own kind{k}" for k in range(6)]
    rows = [(1, lines[0]), (2, lines[0] + " more\n" + lines[1]), (2, lines[2] + "\n" + lines[3]), (2, lines[2] + "\n" + lines[3]), (3, lines[2] + " now"), (4, lines[4]), (4, lines[4] + " again"), (None, lines[5]), (None, "a null id with another text here")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [("1", lines[0]), ("2", lines[1]), ("2", lines[2] + "\n" + lines[3]), ("2", lines[2] + "\n" + lines[3]), ("3", ""), ("None", lines[5]), ("None", rows[8][1])]
    assert [x for x in got if x[0] != "4"] == sorted(want)
    assert len([x for x in got if x[0] == "4" and x[1]]) == 1
