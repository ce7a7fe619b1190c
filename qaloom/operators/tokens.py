"""Token ids and label masks of training records, with a public vocabulary.

Texts are laid out in chat markup, turn by turn; each turn is tokenised by
itself.  The user's turn has no labels; of the assistant's turn the opening
markup and the last line break have none, the answer and the closing mark have.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The label that counts for no loss, and the marks of chats and images, which get ids after the vocabulary's.
IGNORED = -100
MARKS = ("<|im_start|>", "<|im_end|>", "<img>", "</img>", "<IMG_CONTEXT>")


@lru_cache(4)
def tokenizer(vocabulary: str, marks: tuple[str, ...] = ()):
    """The tokenizer of a vocabulary file, given by its path or, in tasks, by the name it was sent under."""
    import tiktoken

    path = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
    # Fixed value: the public split pattern that belongs to this vocabulary.
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    first = max(ranks.values()) + 1
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={m: first + i for i, m in enumerate(marks)})


def send_vocabulary(spark: SparkSession, vocabulary: str) -> str:
    """Send the vocabulary to all executors through Spark's file server; the name to open it by."""
    spark.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary)


def tokenised(encoding, user: str, assistant: str, system: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of one record."""
    encode = lambda t: encoding.encode(t, allowed_special="all")
    before = [] if system is None else encode(f"<|im_start|>system\n{system}<|im_end|>\n")
    before = before + encode(f"<|im_start|>user\n{user}<|im_end|>\n")
    own = encode(f"<|im_start|>assistant\n{assistant}<|im_end|>\n")
    opening = len(encode("<|im_start|>assistant\n"))
    ids = np.array([*before, *own], dtype=np.int32)
    labels = ids.copy()
    labels[: len(before) + opening] = IGNORED
    labels[-1] = IGNORED
    return ids, labels


def sft_tokens(records: DataFrame, key: str = "sample_id", user: str = "user_text", assistant: str = "assistant_text", longest: int | None = None, vocabulary: str = VOCABULARY, system: str | None = None) -> DataFrame:
    """(key, ids, labels): a null text is ''; records longer than allowed are an error, never cut."""
    name = send_vocabulary(records.sparkSession, vocabulary)

    def work(batches):
        encoding = tokenizer(name, MARKS)
        for batch in batches:
            ids, labels = [], []
            for k, u, a in zip(batch["k"], batch["u"], batch["a"]):
                i, l = tokenised(encoding, u, a, system)
                if longest is not None and len(i) > longest:
                    raise ValueError(f"{k}: {len(i)} tokens, {longest} allowed")
                ids.append(i)
                labels.append(l)
            yield pd.DataFrame({key: batch["k"], "ids": ids, "labels": labels})

    rows = records.select(F.col(key).alias("k"), F.coalesce(user, F.lit("")).alias("u"), F.coalesce(assistant, F.lit("")).alias("a"))
    return rows.mapInPandas(work, f"{key} {records.schema[key].dataType.simpleString()}, ids array<int>, labels array<int>")


def supervised_text(tokens: DataFrame, key: str = "sample_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_ids, text): what the labels spell."""
    name = send_vocabulary(tokens.sparkSession, vocabulary)

    def work(batches):
        encoding = tokenizer(name, MARKS)
        for batch in batches:
            texts = [encoding.decode([int(x) for x in l if x != IGNORED]) for l in batch["labels"]]
            yield pd.DataFrame({key: batch[key], "n_ids": [len(l) for l in batch["labels"]], "text": texts})

    return tokens.select(key, "labels").mapInPandas(work, f"{key} {tokens.schema[key].dataType.simpleString()}, n_ids long, text string")
