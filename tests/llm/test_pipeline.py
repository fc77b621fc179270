"""The pipeline's stages, each against brute force on what the one before kept."""

import random
from collections import Counter

import corpus_pipeline as cp
from quarrylight.llm import mixing

from .test_operators import WORD, brute_groups, brute_lines, corpus


def fixture():
    """Two made-up languages, shared runs of lines, near copies, texts without letters."""
    r = random.Random(12)
    parts = {"en": ["the", "and", "ing", "or"], "de": ["sch", "ung", "zu", "ein"]}
    word = lambda g: "".join(r.choice(parts[g]) for _ in range(r.randint(1, 4)))
    rows = []
    for i, (d, text, lang, source) in enumerate(corpus(40, seed=21)):
        text = None if text is None else WORD.sub(lambda m: m[0] if m[0] == "edited" else "wort" + m[0].replace("w", "x") if lang == "de" else "the" + m[0], text)
        rows.append((d, text, lang, source))
    rows += [(5000 + i, " ".join(word(g) for _ in range(r.randint(20, 60))), g, "ab"[i % 2]) for i, g in enumerate(["en", "de"] * 20)]
    return rows + [(6000, "123 456 --", "en", "a"), (6001, "", "de", None)]


def test_stages(spark, tmp_path):
    rows = fixture()
    full = [(d, t, g, s, None if t is None else len(t)) for d, t, g, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [tuple(x) for x in cp.language_id(spark, docs, str(tmp_path)).collect()]
    lettered = [x for x in full if x[1] and any(c.isalpha() for c in x[1])]
    assert set(kept) <= set(lettered) and len(kept) >= 0.95 * len(lettered)

    stage = spark.createDataFrame(kept, docs.schema)
    deduped = [tuple(x) for x in cp.dedup_lines(spark, stage, "").collect()]
    expected = brute_lines([x[:4] for x in kept])
    assert sorted(map(str, deduped)) == sorted(str((d, e, g, s, len(e))) for d, t, g, s, _ in kept for e in [expected[(d, t)]])

    stage = spark.createDataFrame(deduped, docs.schema)
    single = [tuple(x) for x in cp.drop_near_copies(spark, stage, "").collect()]
    groups = brute_groups([x[:4] for x in deduped])
    assert sorted(map(str, single)) == sorted(str(x) for x, (d, _, c) in zip(deduped, groups) if d is None or c == d)

    stage = spark.createDataFrame(single, docs.schema)
    mixed = [tuple(x) for x in cp.mix_sources(spark, stage, "").collect()]
    size = lambda x: len(WORD.findall(x[1] or ""))
    sizes, taken = Counter(), Counter()
    for x in single:
        sizes[x[3]] += size(x)
    for x in mixed:
        taken[x[3]] += size(x)
    own, more = Counter(single), Counter(mixed)
    assert all(n <= 2 * own[x] for x, n in more.items()) and set(more) <= set(own)
    for s, t in mixing.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(map(size, single)) / 2

    out = cp.tokenize(spark, spark.createDataFrame(mixed, docs.schema), "").collect()
    assert len(out) == len(mixed) and all(x["round_trip"] for x in out)


def test_stage_list():
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "sentencepiece"] and cp.ORACLE_SQL is None


def test_stages_take_odd_tables(spark):
    """Empty tables, further columns with clashing names, rows that share a doc_id."""
    text = " ".join(f"wort{i}" for i in range(30))
    rows = [(1, text, "en", "a", 1), (2, text + " more", "en", "a", 1), (2, "another text altogether, with words of its own", "en", None, 1), (None, text, None, "a", None), (3, None, "en", "a", None), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int, pattern int, text_hash int, n_removed int, score int")
    for name, stage in cp.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, "")
            n = out.count()
            assert n == 0 if table is not docs else n > 0, name
            assert name == "sentencepiece" or out.columns == list(cp.COLUMNS)
    kept = [tuple(r)[:2] for r in cp.drop_near_copies(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [r[:2] for r in rows if r[1] != text + " more"]))
