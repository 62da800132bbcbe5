"""Segmentation of chunk streams: a progress row for every chunk, a result when a document's last chunk is in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill import config as settings
from lexmill.operators import scenes, sentences
from lexmill.operators.language import detect

EVENTS = "doc_id long, event string, chunk_index int, chunks_total int, sentences_so_far long, texts array<string>"
_STATE = "seen int, chunks array<struct<no:int,texts:array<string>>>"


def split_chunks(chunks: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """(doc_id, chunk_no, chunks_total, texts): the sentences of each chunk; works on streams and tables."""
    settings.load(config)
    return sentences.split_texts(detect(chunks).drop("confidence")).select("doc_id", "chunk_no", "chunks_total", "texts")


def events(chunks: DataFrame, config: dict[str, Any] | None = None, wait_minutes: float | None = None) -> DataFrame:
    """A stream of (doc_id, chunk_no, chunks_total, text) as events.

    Each chunk gives a progress event with the sentences so far, once; a repeated chunk gives none. The last missing chunk
    also gives the result event with all sentences in order, and the state goes. Where `wait_minutes` is given (as it should
    be on streams that may lose chunks), a document to which no chunk comes for so long gives an error event with the
    number of its sentences so far, and its state goes; the query then also runs batches without data.
    """
    columns = ["doc_id", "event", "chunk_index", "chunks_total", "sentences_so_far", "texts"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {no: list(texts) for no, texts in state.get[1]} if state.exists else {}
        rows = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "error", max(held, default=0), None, sum(map(len, held.values())), [])], columns=columns)
            return
        for pdf in batches:
            for r in pdf.sort_values("chunk_no").itertuples():
                if int(r.chunk_no) in held:
                    continue
                held[int(r.chunk_no)] = list(r.texts)
                rows.append((key[0], "progress", int(r.chunk_no), int(r.chunks_total), sum(map(len, held.values())), []))
                if len(held) == int(r.chunks_total):
                    rows.append((key[0], "result", int(r.chunk_no), int(r.chunks_total), sum(map(len, held.values())), [t for no in sorted(held) for t in held[no]]))
        if rows and rows[-1][1] == "result":
            state.remove()
        else:
            state.update((len(held), [(no, texts) for no, texts in held.items()]))
            if wait_minutes is not None:
                state.setTimeoutDuration(max(1, int(wait_minutes * 60_000)))
        yield pd.DataFrame(rows, columns=columns)

    return split_chunks(chunks, config).groupBy("doc_id").applyInPandasWithState(step, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout if wait_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)


def results(stream_events: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """Result events with language, sentences and scenes over the whole document."""
    config = settings.load(config)
    done = stream_events.where("event = 'result'").select("doc_id", "texts", F.array_join("texts", " ").alias("text"))
    done = detect(done).drop("confidence", "text")
    done = done.select("doc_id", "language", sentences.records(F.col("texts"), F.col("language"), F.lit("tier3_rule")).alias("sentences"))
    return scenes.totals(scenes.pack_documents(done, config["scene"]))


def progress(chunks: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """The same progress over a table of chunks: running counts in chunk order."""
    from pyspark.sql import Window

    done = split_chunks(chunks, config)
    order = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return done.select("doc_id", F.col("chunk_no").alias("chunk_index"), "chunks_total", F.sum(F.size("texts")).over(order).alias("sentences_so_far"))
