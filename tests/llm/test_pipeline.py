from collections import Counter

import corpus_pipeline as pipeline
from quirelake.llm import bpe_coding, near_duplicates
from test_contracts import DOCS, near_groups, removed_words, words

HUGE = " ".join(f"giant{i % 4999}word{i % 13}" for i in range(120_000))
ODD = [*DOCS, (30, HUGE, "en", "c"), (31, HUGE + " end", "en", "c"), (32, DOCS[3][1], "en", "a"), (32, DOCS[3][1], "en", "a")]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, n, ids = docs.columns, docs.count(), None
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        if k < 4:
            assert out.columns == cols
        if k == 0:
            assert out.count() >= 0.98 * n
        if k == 1:
            want = {r.id for r in near_duplicates.groups(docs).collect() if r.id == r.component_id}
            ids = {r.doc_id for r in out.collect()}
            assert ids == want
        if k == 2:
            assert {r.doc_id for r in out.collect()} == ids
        if k == 3:
            assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        docs = out
    assert docs.count() > 0 and docs.where("n_tokens <> size(token_ids)").count() == 0


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_odd_rows_stage_by_stage(spark, tmp_path):
    """Null, empty, very long and repeated rows, and columns named like results, against brute force."""
    from tokenizers import Tokenizer

    more = "*, length(text) n_chars, 1 score, 'x' accepted, 2 N_words, 3 taken, 'y' component_id"
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").selectExpr(*more.split(", ")).write.parquet(str(tmp_path / "documents.parquet"))
    docs, cols = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    rows_of = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before, cols = rows_of(docs), docs.columns
        out = stage(spark, docs, str(tmp_path)).cache()
        after = rows_of(out.withColumn("text", out.token_ids.cast("string")) if k == 4 else out)
        if k < 4:
            assert out.columns == cols
        if k == 0:
            assert not [t for _, t, *_ in after if not words(t)] and len(after) >= 0.7 * len(before)
            assert not Counter(after) - Counter(before)
        if k == 1:
            named = [r for r in before if r[0] is not None]
            want = {i for (i, _), (_, c) in near_groups(named).items() if i == c}
            assert Counter(r[0] for r in after) == Counter(want | {None} if any(r[0] is None for r in before) else want)
        if k == 2:
            want = Counter((r[0], t if gone else r[1]) for r, (_, gone, t) in zip(before, removed_words(before), strict=True))
            assert Counter(r[:2] for r in after) == want
        if k == 3:
            times, size = Counter(after), Counter()
            for r in before:
                size[r[3]] += len(words(r[1]))
            assert set(times) <= set(before) and all(n <= 2 * before.count(r) for r, n in times.items())
            assert sum(len(words(r[1])) for r in after) <= 2 * sum(size.values())
        if k == 4:
            lib = Tokenizer.from_file(bpe_coding.default_tokenizer())
            said = {(r[0], r[3]): [] for r in before}
            for r in before:
                said[r[0], r[3]].append(str(lib.encode(r[1] or "", add_special_tokens=False).ids))
            got = {key: [] for key in said}
            for r in after:
                got[r[0], r[3]].append(r[1])
            assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in said.items()}
        docs = out


def test_run(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_tokens == len(r.token_ids) for r in out)
