"""Token counts of whole texts, by overlap resynchronisation for huge ones.

A byte-level BPE tokenizer first cuts a text into pre-tokens with a regular expression that scans from left to right and
never looks behind, then merges inside each pre-token. So if the scans of two overlapping chunks both begin a pre-token
at p, they agree from p on, as far as both see the text; and a boundary of the left chunk is one of the whole text if it
lies at least the longest special string before the chunk's end. Texts over `max_chars` are encoded in overlapping chunks
with offsets and spliced at such a common boundary. While an overlap holds none, it is doubled; once it would hold the
whole left chunk, that chunk is made longer instead. Memory is bounded by two chunks unless one pre-token is longer.
"""

from __future__ import annotations

import functools
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table, tokenizer_path

#: Characters on whose classes all regular-expression engines agree: a text of these only may be counted by ranks.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


@functools.lru_cache(4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def load_ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def pretoken_starts(tokenizer, chunk: str) -> tuple[list[int], list[int]]:
    """Where each pre-token of the chunk begins, and how many tokens come before it; last, the chunk's end and all tokens."""
    e = tokenizer.encode(chunk, add_special_tokens=False)
    starts, before, last = [], [], None
    for k, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets)):
        if word != last:
            starts.append(start)
            before.append(k)
            last = word
    return [*starts, len(chunk)], [*before, len(e.ids)]


def count_resynchronised(tokenizer, text: str, chunk: int = 16_384, overlap: int = 256) -> int:
    """Tokens of text, holding the tokens of two overlapping chunks at a time."""
    guard = max([1, *map(len, special_strings(tokenizer))])
    n, total, a, size = len(text), 0, 0, chunk + overlap
    starts, before = pretoken_starts(tokenizer, text[:size])
    done = 0  # tokens of the chunk at a that lie before the last splice
    while a + size < n:
        b, wide, splice = a + size, overlap, None
        at_left = {a + s: k for s, k in zip(starts[:-1], before) if a + s <= b - guard and k >= done}
        while splice is None and wide < size:
            r = b - wide
            new_starts, new_before = pretoken_starts(tokenizer, text[r : b + chunk])
            splice = next(((r + s, k) for s, k in zip(new_starts[:-1], new_before) if s and r + s in at_left), None)
            if splice is None:
                wide *= 2
        if splice is None:
            size *= 2
            starts, before = pretoken_starts(tokenizer, text[a : a + size])
            continue
        total += at_left[splice[0]] - done
        a, size, done, starts, before = r, wide + chunk, splice[1], new_starts, new_before
    return total + before[-1] - done


def count_texts(texts: list[str | None], path: str, max_chars: int, ranks: str | None = None) -> list[int]:
    """Counts by the library; by the same vocabulary's ranks, which is faster, where a text is plain and holds no special
    string."""
    tokenizer = load(path)
    ranked, special = load_ranks(ranks).encode_ordinary if ranks else None, special_strings(tokenizer)
    out, rest = [0] * len(texts), []
    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) > max_chars:
            out[k] = count_resynchronised(tokenizer, text)
        elif ranked and PLAIN.fullmatch(text) and not any(s in text for s in special):
            out[k] = len(ranked(text))
        else:
            rest.append(k)
    for k, e in zip(rest, tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
        out[k] = len(e.ids)
    return out


def token_count(text: Column, tokenizer: str, max_chars: int = 32_768, ranks: str | None = None) -> Column:
    """The number of tokens of a text column (null and empty: 0), without special tokens added; special strings inside a
    text count as the library's default has it. tokenizer: a .json file's path or public name; ranks: the same vocabulary
    as ranks, if there is such a file."""
    path, ranks_path = tokenizer_path(tokenizer), tokenizer_path(ranks) if ranks else None

    @F.pandas_udf("long")
    def count(batch: pd.Series) -> pd.Series:
        texts, out = batch.tolist(), []
        for k in range(0, len(texts), 256):
            out += count_texts(texts[k : k + 256], path, max_chars, ranks_path)
        return pd.Series(out, dtype="int64")

    return count(text)


def with_token_counts(docs: DataFrame, tokenizer: str, limit: int, text_col: str = "text", max_chars: int = 32_768, ranks: str | None = None) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; columns of these names are replaced, others kept. Rows with null or empty
    texts have 0, 0, false; equal rows stay apart; an empty table gives an empty one."""
    out = docs.withColumn("n_tokens", token_count(F.col(text_col), tokenizer, max_chars, ranks))
    return out.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, "byte_bpe_50k.json", 512, ranks="byte_bpe_50k.tiktoken").select("doc_id", "n_bytes", "n_tokens", "over_limit")
