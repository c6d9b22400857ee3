"""The pipeline's stages on a small corpus, each against a plain rule over the stage's own input."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_targets

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    parts = {"xx": ["the", "and", "tion", "ing", "wh"], "yy": ["der", "sch", "ung", "keit", "lo"]}
    prose = lambda lang, n: [a + b for a, b in zip(rnd.choices(parts[lang], k=n), rnd.choices(parts[lang], k=n), strict=True)]
    item = " ".join(prose("xx", 25))
    rows = []
    for i in range(240):
        lang = rnd.choice(["xx", "yy"])
        words = prose(lang, rnd.choice([20, 40, 80]))
        if i % 6 == 0:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moron"])
        rows.append([i, " ".join(words), lang, f"s{i % 4}", 0])
    for i in (301, 302, 303):
        rows.append([i, rows[i - 300][1] + (" more" if i == 303 else ""), "xx", "s1", 0])
    rows.append([310, " ".join(prose("yy", 30)) + ". " + item.upper() + " " + " ".join(prose("yy", 5)), "yy", "s2", 0])
    rows += [[320, None, "xx", None, 0], [321, "", "xx", "s1", 0], [322, "12 34 !", None, "s1", 0]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int("idiot" in r[1] or "moron" in r[1])) for r in rows if r[1] and r[0] < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_stages(spark, corpus, tmp_path):
    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = dict(text)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_copies", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        was, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "mixing":
            break
        assert docs.columns == was.columns
        got = {r.doc_id for r in docs.collect()}
        if name == "toxicity":
            kept = {i: t for i, t in kept.items() if not re.search("idiot|moron", t or "")}
        elif name == "language":
            kept = {i: t for i, t in kept.items() if re.search("[a-z]", (t or "").lower())}
        elif name == "near_copies":
            ids = sorted(kept)
            _, own = brute_components([kept[i] for i in ids])
            kept = {i: kept[i] for n, i in enumerate(ids) if own[n] == n}
        else:
            kept = {i: t for i, t in kept.items() if item not in t.lower()}
        assert got == set(kept), name
    assert 310 not in kept and not {301, 302, 303} & set(kept)
    sizes, taken = {}, {}
    source = {r.doc_id: r.source for r in was.collect()}
    for i, t in kept.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(t.split())
    for r in docs.collect():
        taken[r.source] = taken.get(r.source, 0) + r.size
        assert 1 <= r.copy <= r.copies <= 3
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= 2 * 90
    assert docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c")).where("n <> c").count() == 0


def test_language_keeps_short_texts(spark, corpus):
    folder, _ = corpus
    short = [(401, "A."), (402, "Ung."), (403, "Qu!"), (404, "K"), (405, "Edrere."), (406, "7."), (407, None)]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300")
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, "s1", 0) for i, t in short], docs.schema))
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs, folder).where("doc_id > 400").collect()}
    assert got == {401, 402, 403, 404, 405}


def test_language_rejects_by_its_prediction(spark, corpus):
    """Texts full of letters go if they are in no learned language, or in one that is not wanted; clashing columns stay."""
    folder, _ = corpus
    rnd = random.Random(4)
    other = [" ".join("".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(120)) for letters in ("бвгдежзиклмн", "αβγδεζηθικλ", "qxzjkvpy")]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300")
    more = spark.createDataFrame([(500 + k, t, None, "s1", 0) for k, t in enumerate(other)] + [(510, "der die das " * 40, "yy", "s1", 0)], docs.schema)
    every = docs.unionByName(more).withColumn("score", F.lit("mine")).withColumn("lang_pred", F.col("doc_id"))
    got = corpus_pipeline.language(spark, every, folder).collect()
    assert not {500, 501, 502} & {r.doc_id for r in got} and {r.doc_id for r in docs.collect()} <= {r.doc_id for r in got}
    assert {r.score for r in got} == {"mine"} and all(r.lang_pred == r.doc_id for r in got)
    yy = corpus_pipeline.language(spark, every, folder, wanted=("yy",)).collect()
    assert {r.lang for r in yy} <= {"yy"} and {r.doc_id for r in docs.where("lang = 'yy'").collect()} <= {r.doc_id for r in yy}
    unlearned = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlearned, folder).count() == docs.count() and corpus_pipeline.language(spark, docs.limit(0), folder).count() == 0


def test_run_gives_the_stages_rows(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((r.doc_id, r.copy) for r in df.collect())
    assert key(out) == key(again) and out.count() > 0


def test_near_copies_judge_rows_of_one_id_by_their_texts(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "s"), (2, a, "t"), (2, b, "t"), (3, b, "u"), (None, b, "v"), (4, None, "w"), (4, None, "w"), (5, "", "w"), (6, "alone here", "x"), (6, "alone here", "y")]
    df = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], docs.schema)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in corpus_pipeline.near_copies(spark, df, folder).collect())
    assert got == [(-1, b), (1, a), (4, ""), (5, ""), (6, "alone here")]
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, df.limit(0), folder).count() == 0
