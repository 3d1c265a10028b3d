"""Tables of operators that run at the same time, and links of seeds across tasks."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, passages, similar


def test_scopes_of_two_threads(spark):
    """What a scope deletes is its own: tables of other threads, and of the code around, stay; the session's setting comes back."""
    before = spark.conf.get(common.CLEANUP, "false")
    outer = common.saved(spark.range(5), "outer")
    begun, go, told = threading.Event(), threading.Event(), {}

    def other():
        with common.scope() as keep:
            told["inner"] = common.saved(spark.range(7), "inner")
            told["kept"] = common.saved(spark.range(3), "kept")
            keep(told["kept"])
            begun.set()
            go.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    assert begun.wait(60)
    with common.scope():
        mine = common.saved(spark.range(9), "mine")
    assert told["inner"].count() == 7 and outer.count() == 5
    go.set()
    thread.join()
    assert told["kept"].count() == 3 and outer.count() == 5
    for gone in (mine, told["inner"]):
        with pytest.raises(Exception):
            gone.count()
    assert spark.conf.get(common.CLEANUP, "false") == before


def test_two_operators_at_once(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k // 2) * 100 + i}" for i in range(60))) for k in range(20)], "doc_id long, text string")
    out, threads = {}, []
    for name, run in (("near", lambda: similar.one_of_each(docs).count()), ("passages", lambda: passages.passages(docs).count())):
        threads.append(threading.Thread(target=lambda name=name, run=run: out.update({name: run()})))
        threads[-1].start()
    for t in threads:
        t.join()
    assert out == {"near": 10, "passages": 20}


@pytest.mark.parametrize("rows", [3000, 40])
def test_links_across_tasks(spark, rows):
    """Over many tasks, occurrences get the links that one pass over all of them gives; a seed that one document repeats very often sends no more than a few rows to the driver."""
    r = np.random.default_rng(rows)
    frame = pd.DataFrame({"doc_id": r.integers(0, 12, rows), "seed": r.choice([1, 1, 1, 2, 5, 9], rows), "at": np.arange(rows, dtype=np.int32), "ahead": r.integers(0, 3, rows)})
    frame.loc[: rows // 3, ["doc_id", "seed", "ahead"]] = (3, 1, 1)
    got = {tuple(x) for x in passages.matches(spark.createDataFrame(frame, passages.SEED.replace("doc_id long, seed long", "doc_id long, seed long")).select("doc_id", "seed", "at", "ahead")).select("doc_id", "other_id", "at", "other_at").collect()}
    ordered = frame.sort_values(["seed", "ahead", "doc_id", "at"])
    doc, at = ordered["doc_id"].to_numpy(), ordered["at"].to_numpy()
    i, j = passages.linked(ordered["seed"].to_numpy(), doc, at)
    assert got == set(zip(doc[i].tolist(), doc[j].tolist(), at[i].tolist(), at[j].tolist()))
