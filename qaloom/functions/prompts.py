"""Prompt texts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.answers import strip
from qaloom.functions.timecode import hhmmss


def short_number(x: Column) -> Column:
    """At most six digits, no trailing zeros: 119 rather than 119.0 (for values from 0.0001 to a million)."""
    digits = F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.greatest(F.abs(x), F.lit(0.1)))).cast("int"))
    fixed = F.coalesce(*(F.when(digits == d, F.format_string(f"%.{d}f", x)) for d in range(8)))
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def absolute_labels(start: Column, relative: Column) -> Column:
    """Clock labels of frames given in seconds from the start of a clip."""
    return F.transform(relative, lambda t: hhmmss(start + t))


def image_prefix(labels: Column) -> Column:
    """One ``label: <image>`` line for each frame."""
    return F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit(": <image>\n"))), "")


def single_image_prefix(start: Column) -> Column:
    return F.concat(F.lit("Image at "), hhmmss(start), F.lit(": <image>\n"))


def placeholders(text: Column, mark: str = "<image>") -> Column:
    """How often a mark occurs."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark)))) / len(mark)).cast("bigint")


def expanded(text: Column, tokens: int, patches: int = 1) -> Column:
    """Each image mark replaced by its context tokens."""
    return F.replace(text, F.lit("<image>"), F.lit("<img>" + "<IMG_CONTEXT>" * (tokens * patches) + "</img>"))


def request_prompt(procedure: Column, question: Column) -> Column:
    """The part of the prompt that belongs to one request; null for a blank question."""
    text = F.concat_ws("\n", F.lit("Current request:"), F.concat(F.lit("Procedure type: "), F.coalesce(procedure, F.lit("Unknown"))), F.concat(F.lit("Question: "), strip(question)), F.lit("Answer:"))
    return F.when(strip(question) != "", text)


def global_sampling_text(frames: Column, duration: Column, fps: float, most: int) -> Column:
    """How the frames were sampled: evenly selected if the budget was short, else at the rate."""
    # fixed values: the sentences must match
    evenly = (frames >= most) & (duration > most / fps)
    rate = F.lit(f"{fps:g}")
    a = F.concat(F.lit("The input consists of "), frames.cast("string"), F.lit(" chronologically ordered frames uniformly selected across the "), short_number(duration), F.lit("-second trimmed video segment after sampling at "), rate, F.lit(" fps."))
    b = F.concat(F.lit("The input consists of "), frames.cast("string"), F.lit(" chronologically ordered frames sampled at "), rate, F.lit(" fps from the "), short_number(duration), F.lit("-second trimmed video segment."))
    return F.when(evenly, a).otherwise(b)


def few_shots(examples: Column) -> Column:
    """``Question:``/``Answer:`` blocks of an array of (question, answer)."""
    block = lambda x: F.concat(F.lit("Question: "), strip(x["question"]), F.lit("\nAnswer: "), strip(x["answer"]))
    return F.array_join(F.transform(examples, block), "\n\n")


def filled(template: Column, mark: str, value: Column) -> Column:
    """A template with its one placeholder filled; null if it has none or several."""
    return F.when(placeholders(template, mark) == 1, F.replace(template, F.lit(mark), value))


def anchors_text(anchors: Column) -> Column:
    return F.when(F.size(anchors) == 0, "none").otherwise(F.array_join(F.transform(anchors, hhmmss), ", "))


def chat(user: Column, assistant: Column) -> Column:
    """One exchange in chat markup."""
    return F.concat(F.lit("<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"), assistant, F.lit("<|im_end|>\n"))
