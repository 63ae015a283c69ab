"""The stages in a row, against brute force over what each was given."""

import numpy as np
import pandas as pd

import corpus_pipeline
from placebook.session import fresh_path
from tests.llm.test_operators import brute_links, check_packed, classes_of, contaminated, ids_of, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, docs, folder):
    """The rows after each stage."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
    return out


def test_stages(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    rng = np.random.default_rng(6)
    frame = pd.read_parquet(f"{folder}/documents.parquet")
    item = pd.read_parquet(f"{folder}/benchmark.parquet").text[3]
    clean = " ".join(frame.text[frame.text.str.len().idxmax()].split()[i] for i in rng.permutation(300))
    extra = [(90001, clean), (90002, clean), (90003, "1234 5678 %%%"), (90004, None), (90005, ""), (90006, clean[: len(clean) // 2] + " " + item)]
    more = pd.DataFrame([(i, t, "en", "x", len(t or "")) for i, t in extra], columns=COLUMNS)
    docs = spark.createDataFrame(pd.concat([frame, more]).values.tolist(), "doc_id long, text string, lang string, source string, n_chars long")
    got = {name: rows.toPandas() for name, rows in staged(spark, docs, folder).items()}
    for name in list(got)[:-1]:
        assert list(got[name].columns) == COLUMNS
        assert (got[name].n_chars == got[name].text.str.len()).all()
    known = set(got["language_id"].doc_id)
    assert not known & {90003, 90004, 90005} and {90001, 90002, 90006} <= known
    assert len(known) >= 0.98 * len(frame)

    given = dict(zip(got["language_id"].doc_id, got["language_id"].text, strict=True))
    score, kept = brute_links(given), set(got["near_dedup"].doc_id)
    assert kept <= set(given) and 90002 not in kept
    loose = classes_of(given, [p for p, s in score.items() if s >= 0.78])
    sure = classes_of(given, [p for p, s in score.items() if s >= 0.83])
    assert {loose[i] for i in kept} == set(loose.values())
    assert all(sum(sure[i] == c for i in kept) <= 1 for c in set(sure.values()))

    before = got["near_dedup"].set_index("doc_id").text
    after = got["substring_dedup"].set_index("doc_id").text
    assert set(before.index) == set(after.index)
    assert all(after[i] == before[i] or len(after[i]) < len(before[i]) for i in after.index)

    given = after.to_dict()
    items = pd.read_parquet(f"{folder}/benchmark.parquet").set_index("item_id").text.to_dict()
    bad = {d for d, _ in contaminated(given, items)}
    assert set(got["decontamination"].doc_id) == set(given) - bad

    rows = list(zip(got["decontamination"].doc_id, got["decontamination"].text, strict=True))
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    check_packed(list(got["packing"].itertuples()), rows, tokenizer)
    assert len(ids_of(tokenizer, "")) == 1


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    last = staged(spark, docs, "/root/testdata/sf0.001")
    assert all(rows.isEmpty() for rows in last.values())
