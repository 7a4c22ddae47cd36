"""The pipeline against plain versions of its stages, and on hostile rows."""

import re

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from colloquy.llm import decontamination as D
from colloquy.llm import private_values as V
from colloquy.llm import quality_votes as Q
from colloquy.llm.queries import quality_model

from .test_simhash import slow_components, slow_fingerprint

NAME = "/root/testdata/sf0.001"


def test_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{NAME}/documents.parquet").collect()]
    model = quality_model(spark, NAME)
    kept = [(i, t) for i, t in docs if model.score(np.array([Q.features(t)]))[0] >= Q.THRESHOLD]
    assert len(kept) < len(docs)
    kept.sort()
    label = slow_components([slow_fingerprint(t) for _, t in kept])
    single = [d for k, d in enumerate(kept) if label.index(label[k]) == k]
    assert len(single) < len(kept)
    items = D.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{NAME}/benchmark.parquet").collect()])
    read = items.reader()
    words = [items.words(k) for k in range(len(items.ids))]
    bad = {i for i, t in single if any(np.isin(w, read(t)).sum() * 2 > w.size and D.align(w, read(t))[0] >= n for w, n in zip(words, items.need))}
    assert bad
    want = {i: t for i, t in single if i not in bad}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, NAME).collect()}
    assert set(got) == set(want)
    pattern, changed = re.compile(V.PATTERN), 0
    for i, r in got.items():
        assert list(r.ids) == library.encode(r.text, add_eos=True) and r.n_tokens == len(r.ids) and r.n_chars == len(r.text)
        assert pattern.sub("", r.text) == pattern.sub("", want[i])
        changed += r.text != want[i]
    assert changed


#: Names that operators use, or used, on the way.
CLASHES = "_id _no_id _key _nth _other _bad _bad_key _quality _found _names _in0 c0 text_key fp score ids n_private a.b".split()


def test_hostile(spark, tmp_path):
    """Stages keep columns, of any names, and don't fail on nulls, empty texts and repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a plain text of a few words", "en", None, 1), (5, "x " * 50000, None, "s", 2)]
    more = tuple(range(len(CLASHES)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    wide = f"{schema}, {', '.join(f'`{c}` long' for c in CLASHES)}, _map map<string, int>"
    for table, frame in {
        "documents": spark.createDataFrame(rows, schema),
        "labels": spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None)], "item_id long, text string"),
    }.items():
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    for docs in (spark.createDataFrame([(*r, *more, {"k": 1}) for r in rows], wide), spark.createDataFrame([], wide)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            last = name == "sentence_pieces"
            own = [c for c in docs.columns if not last or c not in ("ids", "n_tokens")]
            assert out.columns[: len(own)] == own
            rows_out = out.collect()
            for r in rows_out:
                values = dict(zip(out.columns, r))
                assert all(values[c] == k for k, c in enumerate(CLASHES) if c in own) and r["_map"] == {"k": 1}
            if name == "near_duplicates" and rows_out:
                assert len(rows_out) == 3


def test_decontaminated_rows(spark, tmp_path):
    """One contaminated text takes no other text of its id, or of no id, with it."""
    item = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew strong tea"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item}"), (None, "clean without an id"), (None, None), (7, item), (7, item), (7, "clean with an id"), (8, "clean too")]
    got = corpus_pipeline.decontaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(None, "clean without an id"), (None, None), (7, "clean with an id"), (8, "clean too")} and len(got) == 4
