import hashlib
import random
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
import __spark_entry__
from querysieve.llm import decontaminate, queries
from querysieve.llm.bpe import read_ranks


def test_stages_over_real_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def by_definition(rows, items, known):
    """What is left of (doc_id, text) after all stages, by loops over whole texts: doc_id -> digest of the ids."""
    kept = [(i, t) for i, t in rows if i in known]

    def sets(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    own, least = [sets(t) for _, t in kept], list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            for b in range(a):
                if least[a] != least[b] and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = [kept[k] for k in range(len(kept)) if least[k] == k]
    data = [t.encode() for _, t in kept]
    count = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    stripped = []
    for (i, _), b in zip(kept, data):
        gone = [False] * len(b)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = [True] * 200
        stripped.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))

    def holds(item, text):
        w, x = decontaminate.words(text), decontaminate.words(item)
        there = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        wanted = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
        return len(wanted & there) >= 0.8 * len(wanted)

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(queries.BYTE_BPE)), special_tokens={})
    ids = {i: library.encode_ordinary(t) for i, t in stripped if not any(holds(x, t) for x in items)}
    return {i: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for i, x in ids.items()}


def test_whole_pipeline_by_definition(spark, tmp_path):
    """Copies, near copies, shared passages and test items planted in a small corpus; no id, text or letter here and there."""
    draw = random.Random(11)
    words = {"xx": [a + b for a in ("ka", "me", "ta", "pu", "vé") for b in ("la", "ri", "lo", "ssi", "na")], "yy": [a + b for a in ("str", "vlk", "hr", "krk", "dom") for b in ("om", "a", "ad", "y", "ů")]}
    items = [" ".join(f"{draw.choice(words['xx'])}{draw.randrange(9)}" for _ in range(20)) for _ in range(3)]
    passage = " ".join(draw.choice(words["yy"]) for _ in range(60))
    rows, langs = [], {}
    for k in range(70):
        lang = draw.choice(["xx", "yy"])
        w = [draw.choice(words[lang]) for _ in range(draw.randint(5, 150))]
        if rows and k % 5 == 0:
            other = draw.choice(rows)
            lang, w = langs[other[0]], other[1].split(" ")
            if len(w) > 60 and k % 2:
                w[draw.randrange(len(w))] = "zzz"
        if k % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split(" ")
        if k % 11 == 0:
            w[1:1] = items[k % 3].split(" ")
        rows.append((k, " ".join(w)))
        langs[k] = lang
    rows += [(200, None), (201, ""), (202, "12 34 !!"), (203, rows[2][1])]
    docs = spark.createDataFrame([(i, t, langs.get(i), "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    known = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert set(range(60)) - known == set() and known.isdisjoint({200, 201, 202})
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = by_definition(rows, items, known)
    assert got == want and 20 < len(want) < len(known) - 5


def test_odd_and_empty_tables_pass_through(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() >= 0


def test_all_operators_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_queries_return_the_contract_columns(spark, sf_dir):
    want = {
        "op2_debruijn": "doc_id n_words n_removed kept_sha256", "op3_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op4_mpegts": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op5_language_id": "doc_id held_out lang_pred score",
        "op6_simhash": "doc_id fingerprint component_id", "op7_runindex": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op8_quality": "doc_id held_out score predicted", "op10_toxicity": "doc_id held_out score predicted",
        "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", "op12_blockrules": "page_id url text n_chars",
        "op13_collocations": "lang rank phrase a l r n score",
    }
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert set(columns.split()) <= set(got.columns), name
        if int(name[2:].split("_")[0]) <= 10:  # a row per document
            assert got.count() == n, name
