"""Operators 3, 4, 8, the pipeline, and every query on the small tables."""

import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from conftest import SF001, SF01
from nnprobe.llm import nb_toxicity, queries
from nnprobe.llm.length_histogram import at_limits, context_limits, length_histogram, quantiles, with_lengths
from nnprobe.llm.low_discrepancy_mix import mix, slots, source_targets, taken_words

DOCS = "doc_id long, source string, text string, size int, target int"


def test_lengths_and_limits(spark):
    import tiktoken  # noqa: F401
    texts = [None, "", "hello world", "hello world", "a b c d e f", "é" * 50, "x " * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    n = {r.doc_id: r.n_tokens for r in with_lengths(df, keep=("doc_id",)).collect()}
    assert n[0] == n[1] == 0 and n[2] == n[3] == 2 and n[4] == 6
    got = context_limits(length_histogram(with_lengths(df)))
    lengths = sorted(n.values())
    for r in got.collect():
        assert r.n_docs == lengths.count(r.n_tokens) and r.docs_longer == sum(x > r.n_tokens for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.cdf == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    wanted = [0, 1, 2, 5, 100, 10**6]
    for r in at_limits(got, wanted).collect():
        assert r.docs_longer == sum(x > r.context_limit for x in lengths)
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in lengths)
    q = quantiles(got, [0.25, 0.5, 1.0]).first()
    assert (q["q0.25"], q["q0.5"], q["q1"]) == (lengths[1], lengths[3], lengths[-1])
    # another vocabulary in the same workers, and two at once
    other = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    text = spark.createDataFrame([("Ungeheuerlichkeiten " * 40,)], "text string")
    sizes = [with_lengths(text, tokenizer=t).first()[0] for t in ("/opt/tokenizers/byte_bpe_50k.tiktoken", other) * 2]
    assert sizes[0] == sizes[2] and sizes[1] == sizes[3] and sizes[0] != sizes[1]
    empty = context_limits(length_histogram(with_lengths(df.limit(0))))
    assert empty.count() == 0 and at_limits(empty, [5]).first().truncated_tokens == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (goal - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        new = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= new


def _mixed(spark, data, **kw):
    df = spark.createDataFrame([(i, s, t, 1, 2) for i, s, t in data], DOCS)
    placed, pieces = mix(df, **kw)
    return taken_words(placed, pieces).collect(), pieces


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_meets_targets(spark, block):
    data = [(i, f"s{i % 7}" if i % 11 else None, "w " * ((i * 37) % 90)) for i in range(300)]
    data += [(400, "s1", None), (401, "s1", ""), (5, "s5", "w " * 50), (None, "big", "w " * 3000), (402, "S", "q")]
    got, pieces = _mixed(spark, data, block_words=block)
    assert len(got) == len(data)
    sizes = {}
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(want[s] - 1.001 <= taken[s] <= want[s] + 1e-6 for s in sizes)
    again, _ = _mixed(spark, data[::-1], block_words=block)
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert pieces.select("slot", "start", "pass").distinct().count() == pieces.count()


def test_mix_has_low_discrepancy(spark):
    data = [(i, f"s{i % 3}", "w " * 100) for i in range(600)]
    df = spark.createDataFrame([(i, s, t, 1, 2) for i, s, t in data], DOCS)
    placed, _ = mix(df, block_words=50)
    targets = source_targets(placed.select("doc_id", "source", "size"))
    share = {r.sid: r.target for r in targets.collect()}
    total = sum(share.values())
    order = [r.sid for r in slots(targets, 50).orderBy("slot").collect()]
    for n in (30, 100, 500, len(order)):
        for sid, t in share.items():
            assert abs(order[:n].count(sid) - n * t / total) < 4


def test_mix_empty(spark):
    got, pieces = _mixed(spark, [])
    assert got == [] and pieces.count() == 0
    got, _ = _mixed(spark, [(1, "a", ""), (2, None, None)])
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op8_nb_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.96
    hit = [r for r in held if r.predicted]
    assert sum(r.toxic for r in hit) / len(hit) > 0.9
    assert sum(r.toxic for r in hit) / sum(r.toxic for r in held) > 0.8


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, ("you stupid fool " if i % 3 == 0 else "a kind word ") * (1 + i % 4), 7) for i in range(60)]
                                 + [(100, None, 7), (101, "", 7), (None, "you stupid fool", 7), (1, "a kind word", 7), (102, "x" * 600_000, 7)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (None, 1), (7, None), (999, 1)],
                                   "doc_id long, toxic int")
    model = nb_toxicity.train(docs, labels)
    got = nb_toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[None] > 0.5 and by[6] > 0.5 and by[7] < 0.5 and by[100] == by[101]
    one = nb_toxicity.train(docs, labels.where("toxic = 0"))
    assert one.bias < 0 and len(one.places) == 0
    none = nb_toxicity.train(docs, labels.limit(0))
    assert none.bias == 0.0 and nb_toxicity.score(docs.limit(0), none).count() == 0
    again = nb_toxicity.train(docs.orderBy("text"), labels)
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_many_labels_join_by_shuffle(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    one = nb_toxicity.train(docs, labels)
    monkeypatch.setattr(nb_toxicity, "LABEL_BROADCAST_ROWS", 0)
    two = nb_toxicity.train(docs, labels)
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.places == two.places).all()


def test_sample_bound(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    small = nb_toxicity.train(docs, labels, sample_rows=150)
    whole = nb_toxicity.train(docs, labels)
    assert (small.places == whole.places).all()          # counts cover all rows; only the fit is bounded
    assert not (small.weights == whole.weights).all()


def test_sample_holds_a_rare_class(spark):
    docs = spark.createDataFrame([(i, f"you stupid fool {i}" if i < 4 else f"a kind word {i}") for i in range(2000)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(2000)], "doc_id long, toxic int")
    rows = nb_toxicity.training_rows(docs, labels)
    n1 = rows.where("toxic = 1").count()
    assert n1
    for bound in (2, 40):
        got = nb_toxicity._sample(rows, rows.count() - n1, n1, bound).groupBy("toxic").count().collect()
        assert {r.toxic for r in got} == {0, 1} and sum(r["count"] for r in got) < 3 * bound + 4
    model = nb_toxicity.train(docs, labels, sample_rows=40)
    by = {r.doc_id: r.score for r in nb_toxicity.score(docs, model).collect()}
    assert len(model.places) and min(by[i] for i in range(4)) > max(by[i] for i in range(4, 2000))
    same = docs.where("doc_id in (1, 7)").unionAll(docs.where("doc_id = 7").crossJoin(spark.range(500)).drop("id"))
    rows = nb_toxicity.training_rows(same, labels)
    n1 = rows.where("toxic = 1").count()
    assert nb_toxicity._sample(rows, rows.count() - n1, n1, 4).select("toxic").distinct().count() == rows.select("toxic").distinct().count()


def test_rare_wording_weighs(spark):
    import random
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(120)]
    rows = [(i, f"{words[i % 120]} some more text", int(i % 120 < 24)) for i in range(960)]     # each word in few documents
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = nb_toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), features=20)
    assert len(model.places) > 1000
    probe = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    by = {r.doc_id: r.score for r in nb_toxicity.score(probe, model).collect()}
    assert min(by[k] for k in range(24)) > max(by[k] for k in range(24, 120))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, SF01), "test")
        assert docs.columns == columns and docs.schema == before.schema
        seen.append(docs.count())
        if name == "line_dedup":
            same = before.join(docs, "doc_id", "left_anti")
            assert same.where("text is null or trim(text) = ''").count() == 0
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]
    left = corpus_pipeline.near_duplicates(docs)
    assert left.where("not kept").count() == 0
    assert corpus_pipeline.contamination(docs, spark.read.parquet(f"{SF01}/benchmark.parquet")).where("contaminated").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mix_sources"]


def brute_line_dedup(rows):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    sites, first = {}, {}
    for r in rows:
        for at, line in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            u = norm(line)
            if u:
                sites.setdefault(u, set()).add(r["source"])
                first[u] = min(first.get(u, (r["doc_id"], at)), (r["doc_id"], at))
    out = {}
    for r in rows:
        if r["text"] is None:
            out[r["doc_id"]] = None
            continue
        lines = r["text"].split("\n")
        gone = [at for at, x in enumerate(lines) if len(sites.get(norm(x), ())) >= 5 and first[norm(x)] != (r["doc_id"], at)]
        left = "\n".join(x for at, x in enumerate(lines) if at not in gone)
        if not gone or re.search(r"[^\x20\x09-\x0D]", left):
            out[r["doc_id"]] = left
    return out


def test_pipeline_equals_brute_force(spark):
    """Every stage against a plain Python version, each on the stage's own input."""
    from test_llm_dedup import brute_components
    from test_llm_text import brute_hits

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    model = nb_toxicity.train(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    table = model.table()

    def brute(name, rows):
        if name == "toxicity":
            import numpy as np
            total = lambda t: model.bias + float(np.sum(model.weights[nb_toxicity._present(t, table)]))
            return {r["doc_id"]: r["text"] for r in rows if total(r["text"]) < 0}
        if name == "line_dedup":
            return brute_line_dedup(rows)
        if name == "near_dedup":
            found = brute_components([(r["doc_id"], r["text"]) for r in rows], 80)
            return {r["doc_id"]: r["text"] for r in rows if found[r["doc_id"]][1] == r["doc_id"]}
        hit = {h[0] for h in brute_hits([(r["doc_id"], r["text"]) for r in rows], items) if h[-1]}
        return {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in hit}

    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = brute(name, [r.asDict() for r in docs.collect()])
        docs = corpus_pipeline.store(stage(spark, docs, SF001), "test")
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = brute_targets(sizes)
    got = corpus_pipeline.mix_sources(spark, docs, SF001).collect()
    for s in sizes:
        assert sum(r.taken for r in got if r.source == s) == int(target[s] + 1e-6)
    assert all(r.taken <= 2 * r.size for r in got) and len(got) == docs.count()


def test_pipeline_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "text without an id", "en", "a", 18), (2, "", "en", None, 0),
            (3, "same words in this text here", "en", "a", 28), (3, "same words in this text here", "en", "a", 28),
            (4, "same words in this text here", "en", "b", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        left = some
        for _, stage in corpus_pipeline.STAGES:
            left = corpus_pipeline.store(stage(spark, left, SF001), "test")
        got = sorted((r.doc_id for r in left.collect()), key=str)
        assert got == ([1, 2, 3, None] if some is docs else [])


def test_pipeline_columns_of_any_name(spark):
    """Working columns of the stages are no one's; a repeated id has one survivor, whatever the order of the rows."""
    rows = [(i, f"words of text number {i} " * 9 + "\nall rights reserved.", "en", f"s{i % 7}", 10, i, "a", "b", "c", "d") for i in range(30)]
    rows += [(3, f"another text of document three, form {k} " * 5, "en", "x", k, 1, "a", "b", "c", "d") for k in range(4)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "_tox", "_nd_doc", "_dc_doc", "_ls_all", "_ls_text"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _tox long, _nd_doc string, _dc_doc string, _ls_all string, _ls_text string"
    seen = []
    for data in (rows, rows[::-1]):
        docs = spark.createDataFrame(data, kinds)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.store(stage(spark, docs, SF001), "test")
            assert docs.columns == names
        got = sorted(tuple(r) for r in docs.collect())
        assert all(r[6:9] == ("a", "b", "c") for r in got) and len({r[0] for r in got}) == len(got)
        seen.append(got)
    assert seen[0] == seen[1]
    # one short line on seven sites: it stays at its first place only
    assert sum("all rights reserved." in r[1] for r in seen[0]) == 1


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    cols = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, SF01)
    assert sorted(df.columns) == sorted(cols)
    fix = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(fix, df.select(cols).collect())) == sorted(map(fix, want.fetchall()))


def test_pages_keep_the_article(spark):
    got = {r.page_id: r.text for r in queries.QUERIES["op6_text_density"](spark, SF001).collect()}
    pages = spark.read.parquet(f"{SF001}/pages.parquet").collect()
    import html
    whole = 0
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        whole += got[p.page_id] == "\n".join(x for x in blocks if x)
        assert "track(" not in got[p.page_id] and "©" not in got[p.page_id]
    assert whole == len(pages)
