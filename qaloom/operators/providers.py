"""Where a model or a decoder plugs in.

A provider is made once per task, answers batches, and each failure stays with
its row: status, error type and message are columns, the answer is then empty.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AnswerProvider(Protocol):
    def load(self) -> None: ...

    def answer(self, row: dict) -> str: ...

    def unload(self) -> None: ...


class NullProvider:
    """Answers nothing, as a run without a model does."""

    def load(self) -> None:
        pass

    def answer(self, row: dict) -> str:
        return ""

    def unload(self) -> None:
        pass


def answered(requests: DataFrame, columns: list[str], make: Callable[[], AnswerProvider] = NullProvider, key: str = "qid") -> DataFrame:
    """(key, answer, latency, status, error_type, error_message)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        provider.load()
        try:
            for batch in batches:
                rows = []
                for row in batch.to_dict("records"):
                    began = time.perf_counter()
                    try:
                        text, status, kind, message = str(provider.answer(row)), "success", "", ""
                    except Exception as e:  # noqa: BLE001 - a failure belongs to its row
                        text, status, kind, message = "", "failed", type(e).__name__, str(e)
                    rows.append((row[key], text, time.perf_counter() - began, status, kind, message))
                yield pd.DataFrame(rows, columns=[key, "answer", "latency", "status", "error_type", "error_message"])
        finally:
            provider.unload()

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, *(c for c in columns if c != key)).mapInPandas(work, f"{key} {kind}, answer string, latency double, status string, error_type string, error_message string")


class AttachedProvider:
    """A provider with an adapter attached after it is loaded; the adapter's configuration is checked before by ``contracts.adapter_rules``."""

    def __init__(self, base: AnswerProvider, attach: Callable[[AnswerProvider], None]):
        self.base, self.attach = base, attach

    def load(self) -> None:
        self.base.load()
        self.attach(self.base)

    def answer(self, row: dict) -> str:
        return self.base.answer(row)

    def unload(self) -> None:
        self.base.unload()


class Judge(Protocol):
    def load(self) -> None: ...

    def score(self, reference: str | None, candidate: str | None) -> float: ...

    def unload(self) -> None: ...


class SameText:
    """Full score if both texts are the same but for letter case and outer white space."""

    def load(self) -> None:
        pass

    def score(self, reference: str | None, candidate: str | None) -> float:
        return float(reference is not None and candidate is not None and reference.strip().lower() == candidate.strip().lower())

    def unload(self) -> None:
        pass


def judged(rows: DataFrame, by: list[str], make: Callable[[], Judge] = SameText, reference: str = "reference_answer", candidate: str = "candidate_answer") -> DataFrame:
    """(by, n, mean_score): a judge's mean score of each group.

    The judge is made once a task; scores are averaged in the tasks before the
    exchange, so no group is ever together.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        judge.load()
        try:
            for batch in batches:
                yield batch[by].assign(score=[judge.score(r, c) for r, c in zip(batch["_reference"], batch["_candidate"])])
        finally:
            judge.unload()

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    scored = rows.select(*by, F.col(reference).alias("_reference"), F.col(candidate).alias("_candidate")).mapInPandas(work, f"{fields}, score double")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def prepared(images: DataFrame, prepare: Callable[[bytes, dict], bytes], columns: list[str], key: str = "path", image: str = "content") -> DataFrame:
    """(key, image, error): each image through a function of its bytes and its other columns.

    The place of decoding, tiling and normalising, of resizing with a time drawn
    in, and of encoding; an image that fails keeps its row with the error.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    out.append((row[key], prepare(row[image], {c: row[c] for c in columns}), ""))
                except Exception as e:  # noqa: BLE001 - a failure belongs to its row
                    out.append((row[key], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "image", "error"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, image, *columns).mapInPandas(work, f"{key} {kind}, image binary, error string")


def stored(images: DataFrame, store: Callable[[str, bytes], bool], key: str = "path", image: str = "image") -> DataFrame:
    """(n_written, n_reused, bytes): images given to a store, which says whether it wrote (or had) each."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wrote = [bool(store(k, x)) for k, x in zip(batch["k"], batch["x"])]
            yield pd.DataFrame({"wrote": wrote, "size": [len(x) for x in batch["x"]]})

    rows = images.select(F.col(key).alias("k"), F.col(image).alias("x")).where("k is not null and x is not null").dropDuplicates(["k"])
    done = rows.mapInPandas(work, "wrote boolean, size long")
    return done.agg(F.count_if("wrote").alias("n_written"), F.count_if(~F.col("wrote")).alias("n_reused"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def decoded(jobs: DataFrame, decode: Callable[[str, list[int]], list[bytes]], video: str = "video", index: str = "source_index") -> DataFrame:
    """(video, source_index, image): frames of each job decoded together; one group is one batch of one video, never a whole video.

    jobs: one row per frame with ``video``, ``batch`` and ``source_index``.
    """

    def work(group: pd.DataFrame) -> pd.DataFrame:
        wanted = sorted(set(group[index]))
        return pd.DataFrame({"video": group[video].iloc[0], "source_index": wanted, "image": decode(group[video].iloc[0], wanted)})

    return jobs.select(video, "batch", index).groupBy(video, "batch").applyInPandas(work, "video string, source_index long, image binary")


def inspected(videos: DataFrame, inspect: Callable[[str], tuple[float, int]], video: str = "video") -> DataFrame:
    """(video, fps, total_frames, duration_s, error): each video opened once, whatever fails stays with its row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch[video]:
                try:
                    fps, frames = inspect(name)
                    if fps <= 0 or frames <= 0:
                        raise ValueError(f"rate {fps}, frames {frames}")
                    rows.append((name, float(fps), int(frames), frames / fps, ""))
                except Exception as e:  # noqa: BLE001 - a failure belongs to its row
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["video", "fps", "total_frames", "duration_s", "error"]).astype({"total_frames": "Int64"})

    return videos.select(video).where(f"{video} is not null").distinct().mapInPandas(work, "video string, fps double, total_frames long, duration_s double, error string")
