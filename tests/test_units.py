import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparrowfold.functions import text
from sparrowfold.operators import chunking, profile, units
from sparrowfold.sources import tables as src


def line(n, text, page=1, block=0, y0=100.0, size=11.0, bold=False, doc="d"):
    return (doc, n, text, page, block, 0, (50.0, y0, 550.0, y0 + 10), size, bold)


def lines(spark, rows):
    return spark.createDataFrame(rows, src.LINES)


def got(spark, rows):
    out = units.reconstruct(lines(spark, rows)).orderBy("document_id", "source_order").collect()
    return [(r.text, r.unit_type, r.page_number) for r in out]


def test_reconstruction(spark):
    rows = [
        line(1, "Title", size=18.0, bold=True), line(2, "First line of", block=1), line(3, "a paragraph.", block=1), line(4, "• item one", block=2), line(5, "goes on", block=2), line(6, "next", block=3),
        line(7, "next page", page=2, block=3), line(8, "12", page=2, block=4), line(9, "•", page=2, block=5), line(10, "Head", page=2, block=5, size=14.0), line(11, "swallowed", page=2, block=5), line(12, " ", page=2, block=6),
    ]
    assert got(spark, rows) == [
        ("Title", "heading", 1), ("First line of a paragraph.", "paragraph", 1), ("item one goes on", "list_item", 1), ("next", "paragraph", 1), ("next page", "paragraph", 2),
        ("Head", "heading", 2), ("swallowed", "list_item", 2),
    ]


def model(kinds):
    """One pass over (kind, block) lines of one page: texts of units in order of their end, headings at once."""
    out, open_ = [], None

    def close():
        nonlocal open_
        if open_ and open_[1]:
            out.append(tuple(open_[1]))
            open_ = None

    for n, (kind, block) in enumerate(kinds):
        if kind == "H":
            close()
            out.append((n,))
        elif kind in "LE":
            close()
            open_ = [block, [n] if kind == "L" else []]
        elif open_ and open_[0] == block:
            open_[1].append(n)
        else:
            close()
            open_ = [block, [n]]
    close()
    return out


def test_all_short_line_sequences(spark):
    text = {"H": lambda n: f"h{n}", "L": lambda n: f"• l{n}", "E": lambda n: "•", "P": lambda n: f"p{n}"}
    cases = list(itertools.product(itertools.product("HLEP", (0, 1)), repeat=3)) + random.Random(1).sample(list(itertools.product(itertools.product("HLEP", (0, 1)), repeat=4)), 250)
    rows = []
    for d, case in enumerate(cases):
        # a long line fixes the body size; it stands on a page of its own
        rows.append(line(1000, "x" * 99, page=2, doc=str(d)))
        rows += [line(n, text[k](n), block=b, size=18.0 if k == "H" else 11.0, doc=str(d)) for n, (k, b) in enumerate(case)]
    found: dict = {}
    for r in units.reconstruct(lines(spark, rows)).where("page_number = 1").orderBy("document_id", "source_order").collect():
        found.setdefault(r.document_id, []).append(tuple(int(w[1:]) for w in r.text.split()))
    for d, case in enumerate(cases):
        assert sorted(found.get(str(d), [])) == sorted(model(case)), case


def test_fonts_and_boilerplate(spark):
    rows = [line(n, "Running head", page=n, y0=20.0) for n in range(1, 4)] + [line(10 + n, f"body text {n}", page=n) for n in range(1, 4)] + [line(20, "Running head", page=4), line(21, "aaaa", size=9.04, page=4), line(30, "seen twice", page=1, y0=740.0), line(31, "seen twice", page=2, y0=740.0)]
    df = lines(spark, rows)
    assert [r.key for r in units.repeated_boilerplate(df).collect()] == ["running head"]
    left = {(r.text, r.page_number) for r in units.without_boilerplate(df).collect()}
    assert ("Running head", 4) in left and ("Running head", 1) not in left and ("seen twice", 1) in left
    tie = lines(spark, [line(1, "aaaa", size=9.0), line(2, "bbbb", size=12.0), line(3, "cc", size=30.0)])
    assert units.body_font(tie).first().body_font_size == 9.0


def unit_rows(spark, *types_pages):
    return spark.createDataFrame([("d", k, f"w{k}", "heading" if t == "H" else "paragraph", p) for k, (t, p) in enumerate(types_pages)], "document_id string, source_order int, text string, unit_type string, page_number int")


def section_ids(spark, *types_pages):
    return [r.section_index for r in profile.sections(unit_rows(spark, *types_pages)).orderBy("source_order").collect()]


def test_sections(spark):
    assert section_ids(spark, ("H", 2), ("H", 2), ("H", 3), ("P", 3)) == [0, 0, 1, 1]
    assert section_ids(spark, ("H", 1), ("H", 1), ("P", 1), ("H", 1), ("P", 1)) == [0, 0, 0, 1, 1]
    assert section_ids(spark, ("P", 1), ("P", 2), ("H", 2)) == [0, 0, 1]


def test_sections_of_one_huge_document(spark, monkeypatch):
    """Segments of one document lie in many tasks, and give the sections that a loop over the whole gives."""
    monkeypatch.setattr(profile, "SEGMENT", 7)
    rng = random.Random(6)
    rows, page, order = [], 1, 0
    for k in range(600):
        page += rng.random() < 0.1
        order += rng.choice([1, 1, 1, 2, 9])
        rows.append(("host", order, f"w{k}", rng.choice(["heading", "heading", "paragraph"]), page))
    want, index = {}, -1
    for k, (_, order, _, kind, page) in enumerate(rows):
        before = rows[k - 1] if k else None
        index += before is None or kind == "heading" and (before[3] != "heading" or before[4] != page)
        want[order] = index
    made = profile.sections(spark.createDataFrame(rows, "document_id string, source_order int, text string, unit_type string, page_number int"))
    got = made.select("source_order", "section_index").collect()
    assert {r.source_order: r.section_index for r in got} == want and len(got) == 600
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scan = spark.createDataFrame(rows, "document_id string, source_order int, text string, unit_type string, page_number int")
        tasks = scan.groupBy("document_id", F.floor(F.col("source_order") / profile.SEGMENT)).count().select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks == 4 and "document_id, _segment" in re.sub(r"#\d+L?", "", profile.sections(scan)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def sectioned(spark, rows):
    return profile.sections(spark.createDataFrame([("d", k, t, kind, p) for k, (t, kind, p) in enumerate(rows)], "document_id string, source_order int, text string, unit_type string, page_number int"))


def test_chunks(spark):
    two = sectioned(spark, [("Enrollment", "heading", 1), ("a b c d e", "paragraph", 1), ("f g h i j", "paragraph", 2)])
    rows = chunking.build_chunks(two, [9], 50).orderBy("chunk_index").collect()
    assert [(r.text, r.heading_context, r.source_unit_orders, r.token_count, r.page_numbers) for r in rows] == [("a b c d e", ["Enrollment"], [0, 1], 8, [1]), ("f g h i j", ["Enrollment"], [0, 2], 8, [1, 2])]
    long = chunking.build_chunks(sectioned(spark, [("H", "heading", 1), ("w " * 20, "paragraph", 1)]), [10], 50).collect()
    assert len(long) == 1 and long[0].token_count == 23 and long[0].fits
    alone = chunking.build_chunks(sectioned(spark, [("One", "heading", 1), ("Two", "heading", 1)]), [3], 50).collect()
    assert [(r.text, r.heading_context) for r in alone] == [("One\nTwo", [])]


def plain_pack(base, sizes, target):
    out, held = [], None
    for k, n in enumerate(sizes):
        if held is None or 2 + base + held + n > target:
            out.append([k])
            held = n
        else:
            out[-1].append(k)
            held += n
    return out


def test_packing_against_a_plain_loop(spark):
    rng = random.Random(4)
    cases = [[rng.randrange(1, 12) for _ in range(rng.randrange(1, 15))] for _ in range(40)]
    rows = [(str(d), 0, "head line", "heading", 1) for d in range(len(cases))] + [(str(d), k + 1, "w " * n, "paragraph", 1) for d, case in enumerate(cases) for k, n in enumerate(case)]
    df = profile.sections(spark.createDataFrame(rows, "document_id string, source_order int, text string, unit_type string, page_number int"))
    found: dict = {}
    for r in chunking.build_chunks(df, [10, 20], 50).orderBy("document_id", "target_tokens", "chunk_index").collect():
        found.setdefault((r.document_id, r.target_tokens), []).append([o - 1 for o in r.source_unit_orders[1:]])
    for d, case in enumerate(cases):
        for target in (10, 20):
            assert found[str(d), target] == plain_pack(2, case, target)


def test_limits_and_coverage(spark):
    df = sectioned(spark, [("H", "heading", 1), ("w " * 60, "paragraph", 1), ("x", "paragraph", 1)])
    made = chunking.build_chunks(df, [10], 50)
    assert chunking.rejected(made).first().largest_chunk == 63 and chunking.accepted(made).count() == 0
    assert chunking.coverage_gaps(df, made).count() == 0
    lost = chunking.coverage_gaps(df, made.where("chunk_index = 0")).collect()
    assert [(r.source_order, r.side) for r in lost] == [(2, "lost")]
    try:
        chunking.strict(made, 50).collect()
    except Exception:
        return
    raise AssertionError("no error over the hard limit")


def test_profiles(spark):
    df = unit_rows(spark, ("H", 1), ("P", 1), ("P", 3))
    rows = {r.unit_type: r for r in profile.token_profile(df).collect()}
    assert rows["all"]["count"] == 3 and rows["heading"]["max"] == 3.0
    head = spark.createDataFrame([("d", 3, 11.0), ("none", 2, 11.0)], "document_id string, page_count int, body_font_size double")
    got_ = {r.document_id: r for r in profile.document_profile(df, head).collect()}
    assert got_["d"].pages_without_units == [2] and got_["none"].pages_without_units == [1, 2] and got_["none"].unit_count == 0
    empty = profile.token_profile(df.where("false")).collect()
    assert [(r.unit_type, r["count"], r["mean"]) for r in empty] == [("all", 0, 0.0)]


def test_spans_to_lines(spark):
    rows = [("d", 1, 0, 0, 0, "Part", 0.0, 10.0, 20.0, 20.0, 10.0, "Arial"), ("d", 1, 0, 0, 1, "B", 25.0, 10.0, 30.0, 20.0, 12.0, "Arial-Bold"), ("d", 1, 0, 1, 0, "  ", 0.0, 0.0, 1.0, 1.0, 10.0, "Arial")]
    df = spark.createDataFrame(rows, "document_id string, page_number int, block_index int, line_index int, span_index int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string")
    out = src.span_lines(df).collect()
    assert [(r.text, r.font_size, r.is_bold, r.bbox.x1) for r in out] == [("Part B", 12.0, True, 30.0)]
    assert out[0].line_no == 10**12


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    parse = lambda path, content: [dict(document_id="a", line_no=k, text=t, page_number=1, block_index=0, line_index=k, bbox=dict(x0=0.0, y0=100.0, x1=1.0, y1=110.0), font_size=11.0, is_bold=False) for k, t in enumerate(content.decode().split("\n"))]  # noqa: C408, E731
    assert [r.text for r in src.file_lines(spark, f"{tmp_path}/a.txt", parse).orderBy("line_no").collect()] == ["one", "two"]
    (tmp_path / "b.txt").write_text(" \n")
    with pytest.raises(Exception, match="no text"):
        src.file_lines(spark, f"{tmp_path}/b.txt", parse).collect()
    import hashlib

    assert src.file_hashes(spark, f"{tmp_path}/a.txt").first().sha256 == hashlib.sha256(b"one\ntwo").hexdigest()
    src.write_json(spark.createDataFrame([("ä", None)], "a string, b int"), f"{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "ä",\n  "b": null\n}\n'
    assert src.read_json(spark, f"{tmp_path}/x.json", "a string, b int").select(F.col("a")).first().a == "ä"


def test_line_numbers_of_large_pages_differ(spark):
    """More than a thousand lines a block, and pages of very many blocks."""
    rows = [("d", p, b, n, 0, "x", 0.0, 0.0, 1.0, 1.0, 9.0, "f") for p, b, n in [(1, 0, 1000), (1, 1, 0), (1, 1000, 0), (2, 0, 0)]]
    lines = src.span_lines(spark.createDataFrame(rows, "document_id string, page_number int, block_index int, line_index int, span_index int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string"))
    assert [(r.page_number, r.block_index, r.line_index) for r in lines.orderBy("line_no").collect()] == [(1, 0, 1000), (1, 1, 0), (1, 1000, 0), (2, 0, 0)]
    html = "<p>a" * 100_002
    numbers = src.page_lines(spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", "<p>b")], "page_id long, url string, html string")).select("line_no")
    assert numbers.distinct().count() == 100_003


def by_words(texts):
    return [len(t.split()) + 2 for t in texts]


def test_chunks_by_a_tokenizer(spark):
    """By words it gives what the additive way gives; by a tokenizer that merges across line ends, what a plain loop gives."""
    rng = random.Random(4)
    rows = [(d, n, " ".join(rng.choice("ab c def".split()) for _ in range(rng.randrange(1, 14))), rng.choice(["heading", "paragraph", "paragraph", "list_item"]), 1 + n // 4) for d in ("a", "b", "c") for n in range(20)]
    made = profile.sections(spark.createDataFrame(rows, "document_id string, source_order int, text string, unit_type string, page_number int"))
    key = lambda rows: sorted((tuple(r.asDict().items()) for r in rows), key=str)
    one, two = chunking.build_chunks(made, [12, 20], 30), chunking.build_chunks_with(made, [12, 20], by_words, 30)
    assert key(one.collect()) == key(two.select(one.columns).collect())

    def merging(texts):
        return [2 + sum(1 for w in t.replace("\n", " ").split(" ") if not w.startswith("a")) + t.count("\n") for t in texts]

    got = sorted((r.chunk_id, r.token_count, r.text, tuple(r.heading_context)) for r in chunking.build_chunks_with(made, [9], merging, 100).collect())
    want = []
    for (document, section), own in itertools.groupby(sorted(made.collect(), key=lambda r: (r.document_id, r.section_index, r.source_order)), key=lambda r: (r.document_id, r.section_index)):
        own = list(own)
        heads = list(itertools.takewhile(lambda r: r.unit_type == "heading", own))
        body, heads = (own[len(heads) :], heads) if len(heads) < len(own) else (heads, [])
        alone = not heads and own[0].unit_type == "heading" and all(r.unit_type == "heading" for r in own)
        parts = []
        for r in body:
            if parts and (alone or merging(["\n".join([*(h.text for h in heads), *(x.text for x in parts[-1]), r.text])])[0] <= 9):
                parts[-1].append(r)
            else:
                parts.append([r])
        for k, p in enumerate(parts):
            want.append((f"{document}-t9-s{section:04d}-c{k:02d}", merging(["\n".join([*(h.text for h in heads), *(x.text for x in p)])])[0], "\n".join(x.text for x in p), tuple(h.text for h in heads)))
    assert got == sorted(want)


def test_the_five_cases_of_the_hard_limit(spark):
    w = lambda n: " ".join(["w"] * n)
    long_head = [(w(9), "heading", 1), (w(4), "paragraph", 1), (w(5), "paragraph", 1)]
    cases = {"heading_only": ([(w(9), "heading", 1)], 6), "unit": ([("h", "heading", 1), (w(9), "paragraph", 1)], 6), "first_unit": ([(w(4), "heading", 1), (w(4), "paragraph", 1)], 9), "headings_and_unit": (long_head, 15)}
    for name, (units_, limit) in cases.items():
        made = sectioned(spark, units_)
        for out in (chunking.build_chunks(made, [5], limit), chunking.build_chunks_with(made, [5], by_words, limit)):
            assert name in {r.problem for r in out.collect()} and chunking.rejected(out).first().problems == [name]
            with pytest.raises(Exception, match=name):
                chunking.strict(out).collect()
    # counts that shrink when units are joined, then grow: only the whole chunk is over
    odd = lambda texts: [20 if t.count("x") == 2 and t.endswith("x") else 4 for t in texts]
    assert {c["problem"] for c in chunking.pack_section([dict(text="x", unit_type="paragraph", source_order=k, page_number=1) for k in range(2)], 30, 10, odd)} == {"chunk"}  # noqa: C408
    for targets, limit in (([0], 9), ([10], 9), ([5], 0)):
        with pytest.raises(ValueError):
            chunking.build_chunks(made, targets, limit)


def test_profiles_by_a_tokenizer(spark):
    made = sectioned(spark, [("One", "heading", 1), ("abcdefgh ij", "paragraph", 1)])
    count = text.token_counter(lambda texts: [len(t) for t in texts])
    assert {r.unit_type: r["max"] for r in profile.token_profile(made, count).collect()}["all"] == 11
    assert profile.section_spans(made, count).first().token_count == 15 and profile.section_spans(made).first().token_count == 5
    assert profile.oversized_sections(made, 14, count).count() == 1 and profile.oversized_sections(made, 14).count() == 0
    assert [r.token_count for r in profile.oversized(made, 10, count).collect()] == [11]
    assert {r.target for r in profile.candidate_targets(made, 512, count).collect()} == {32}


def test_sections_stream_through_tasks_in_order(spark):
    """Many sections in few batches: a section that several batches hold is packed whole, as pack_section does it alone."""
    from sparrowfold.operators.chunking import build_chunks_with, pack_section

    count = lambda texts: [len(t) // 2 + 2 for t in texts]
    rows = [(d, s, n, f"unit {d} {s} {n} " + "x" * (n * 7 % 19), "heading" if n == 0 else "paragraph", 1 + n // 5) for d in range(12) for s in range(3) for n in range(1 + (d * s) % 14)]
    frame = spark.createDataFrame(rows[::-1], "document_id long, section_index int, source_order int, text string, unit_type string, page_number int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = build_chunks_with(frame, [20, 40], count, 60)
        got = sorted((r.document_id, r.section_index, r.target_tokens, r.chunk_index, r.token_count, r.text) for r in made.collect())
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for d in range(12):
        for s in range(3):
            own = [dict(zip(("source_order", "text", "unit_type", "page_number"), r[2:])) for r in rows if r[:2] == (d, s)]
            want += [(d, s, t, k, c["n"], "\n".join(u["text"] for u in c["own"])) for t in (20, 40) for k, c in enumerate(pack_section(own, t, 60, count))]
    assert got == sorted(want)


def test_coverage_makes_chunks_once(spark, tmp_path):
    from sparrowfold.operators.chunking import coverage_gaps

    log = str(tmp_path / "made")

    def count(batches):
        for pdf in batches:
            with open(log, "a") as f:
                f.write("x" * len(pdf))
            yield pdf

    schema = "strategy_id string, document_id long, source_unit_orders array<int>"
    chunks = spark.createDataFrame([("a", 1, [0, 1]), ("a", 1, [1, 7]), ("a", 2, None), ("b", 1, [0, 1, 2])], schema).mapInPandas(count, schema)
    units = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)], "document_id long, source_order int")
    got = sorted(tuple(r) for r in coverage_gaps(units, chunks).collect())
    assert got == [("a", 1, 2, "lost"), ("a", 1, 7, "unknown"), ("a", 2, 0, "lost")]
    assert len(open(log).read()) == 4
