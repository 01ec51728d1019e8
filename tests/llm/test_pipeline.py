import hashlib
import re

import pytest

from .test_dedup import plain_near, norm
from .test_mixing import plain_targets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, tmp_path):
    """Each stage against a plain version on what the one before kept; run() gives what the stages give."""
    import random

    rng = random.Random(8)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "pf"]}
    texts = []
    for i in range(260):
        lang = rng.choice(list(sounds))
        texts.append((" ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))), lang))
    texts += [(t.replace(" ", "  "), lang) for t, lang in texts[:20]]
    texts += [(t + " one more word", lang) for t, lang in texts[20:50]]
    texts += [(None, "aa"), ("", None), ("12 34 !!", "bb")]
    rows = [(i, t, lang, f"s{i % 4}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    assert ids("language_id") == [i for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    first = {}
    for i in ids("language_id"):
        first.setdefault(norm(rows[i][1]), i)
    assert ids("exact_dedup") == sorted(first.values())
    near = plain_near([(i, rows[i][1]) for i in ids("exact_dedup")], 5, 80)
    assert ids("near_dedup") == [i for i in near if near[i][2]] and len(ids("near_dedup")) < len(ids("exact_dedup"))
    mixed = ids("source_mixing")
    # each source's words against the plain targets, up to half a document for each of its shards
    words = {i: len(re.findall(r"\S+", rows[i][1])) for i in ids("near_dedup")}
    sizes = {s: sum(n for i, n in words.items() if rows[i][3] == s) for s in {rows[i][3] for i in words}}
    for s, want in plain_targets(sizes).items():
        assert abs(sum(words[i] for i in mixed if rows[i][3] == s) - want) <= max(words.values()), s
    assert set(mixed) <= set(ids("near_dedup")) and max(mixed.count(i) for i in mixed) <= 3
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, hashlib.sha256(" ".join(map(str, [*library.encode(rows[i][1]), 2])).encode()).hexdigest()) for i in mixed)
    assert sorted((r.doc_id, r.ids_sha256) for r in seen["sentencepiece"].collect()) == want
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.ids_sha256) for r in again.collect()) == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int"


def test_empty_and_unlabelled_tables(spark, tmp_path):
    """An empty table gives no rows; without any language nothing can be identified, so nothing stays."""
    for name, rows in (("none", []), ("unlabelled", [(1, "some text here", None, "s", 3, 1), (None, None, None, None, None, None)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows without an id, or with one that stands on several rows, go through every stage by themselves."""
    import random

    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice(["ka", "to", "mi", "ra"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(60), "aa", "s", 1, 1) for i in range(80)] + [(None, say(50), None, "s", 1, 1) for _ in range(6)] + [(5, say(50), None, "s", 1, 1) for _ in range(6)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.text for r in docs.collect()) == sorted(r[1] for r in rows), name
