"""Line-first quality rules: bad lines go, then documents that lose too much.

Each \\n-split line is judged by three rules, and a line that fails one is removed:

* navigation: at least `nav_marks` of `|` and at least a third as many as words;
* punctuation: symbols `[#*$%&|<>]` exceed a tenth of the characters in words, or a line of one or two words has no
  `.`, `!`, `?`, `"`, `:` or `;` at its end;
* boilerplate: a line of at most `boilerplate_words` words holds one of the phrases in BOILERPLATE.

A document goes if its lines that stay hold less than half of its characters in words, or if a base rule fails (under
20 words, or over 30 % of the words in repeated 8-word windows). Null texts count as empty and so fail; very long texts and
lines are read whole; empty tables give empty results; repeated rows are judged one by one; ids may be null or repeat; columns
of any other names pass through keep_good and play no part in judge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import textvec as tv

#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "alle rechte vorbehalten",
    "cookie policy",
    "datenschutzerkl\u00e4rung",
    "pol\u00edtica de privacidad",
    "politique de confidentialit\u00e9",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "todos los derechos reservados",
    "tous droits r\u00e9serv\u00e9s",
)
SYMBOLS = b"#*$%&|<>"
CLOSING = b".!?\":;"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, kept_chars long, base_failed boolean, kept boolean, clean_text string"

_symbol = tv.byte_table(lambda b: b in SYMBOLS)
_closing = tv.byte_table(lambda b: b in CLOSING)
_phrases = re.compile(b"|".join(p.encode() for p in BOILERPLATE))


def _repeat_words(hashes: np.ndarray, text: np.ndarray, n: int, width: int = 8) -> np.ndarray:
    """Words of each text in windows that the text has twice or more."""
    grams = tv.rolling(hashes, width)
    if not len(grams):
        return np.zeros(n, np.int64)
    whole = np.flatnonzero(text[: len(grams)] == text[width - 1 :])
    hit = whole[tv.repeated(tv.mix(grams[whole] + text[whole].astype(np.uint64) * np.uint64(tv.BASE)))]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    return np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n)


def _judge(data: np.ndarray, at: np.ndarray, nav_marks: int, boilerplate_words: int) -> dict[str, np.ndarray]:
    n = len(at) - 1
    starts, ends, text = tv.spans(data, at, tv.NOT_SPACE)
    in_word = tv.NOT_SPACE[data] & tv.FIRST_BYTE[data]
    out = {"n_words": np.bincount(text, minlength=n), "word_chars": tv.per_text(in_word, at), "n_symbols": tv.per_text(_symbol[data], at)}
    out["n_repeat_words"] = _repeat_words(tv.span_hashes(data, starts, ends), text, n)

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([at[:-1], breaks + 1]))
    # A line ends at its \n, or with its text. Both lists have one entry a line: as many \n as lines less one, in each text.
    line_end = np.sort(np.concatenate([at[1:], breaks]))
    line_text = np.repeat(np.arange(n), per_line := np.bincount(np.searchsorted(at, breaks, side="right") - 1, minlength=n) + 1)
    words_in = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    busy = words_in > 0
    hashes = tv.span_hashes(data, line_start[busy], line_end[busy])
    keyed = tv.mix(hashes + line_text[busy].astype(np.uint64) * np.uint64(tv.BASE))
    _, first = np.unique(keyed, return_index=True)
    out["n_dup_lines"] = np.bincount(line_text[busy], minlength=n) - np.bincount(line_text[busy][first], minlength=n)

    def count(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[line_end] - total[line_start]

    chars, marks, bars = count(in_word), count(_symbol[data]), count(data == 124)
    last_word = np.searchsorted(starts, line_end) - 1
    closed = np.zeros(len(line_end), bool)
    closed[busy] = _closing[data[ends[last_word[busy]] - 1]]
    phrased = np.zeros(len(line_end), bool)
    lowered = tv.LOWER_AZ[data].tobytes()
    spots = np.fromiter((x for m in _phrases.finditer(lowered) for x in m.span()), np.int64).reshape(-1, 2)
    if len(spots):
        line = np.searchsorted(line_start, spots[:, 0], side="right") - 1
        phrased[line[spots[:, 1] <= line_end[line]]] = True
    bad = busy & (((bars >= nav_marks) & (3 * bars >= words_in)) | (10 * marks > chars) | ((words_in <= 2) & ~closed) | (phrased & (words_in <= boilerplate_words)))
    out["n_lines"], out["n_bad_lines"] = per_line, np.bincount(line_text[bad], minlength=n)
    out["kept_chars"] = np.bincount(line_text, weights=np.where(bad, 0, chars), minlength=n).astype(np.int64)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (2 * out["kept_chars"] >= out["word_chars"])
    out["bad_spans"] = [line_text[bad], line_start[bad], line_end[bad]]
    return out


def _clean(data: np.ndarray, at: np.ndarray, bad: list[np.ndarray]) -> list[str]:
    """The texts without their bad lines; a line goes with the \\n before it, the first with the one after it."""
    raw, out = data.tobytes(), []
    low, high = (np.searchsorted(bad[0], np.arange(len(at) - 1), side=s) for s in ("left", "right"))
    for k in range(len(at) - 1):
        if low[k] == high[k]:
            out.append(raw[at[k] : at[k + 1]].decode())
            continue
        gone = set(bad[1][low[k] : high[k]].tolist())
        place, lines = int(at[k]), []
        for line in raw[at[k] : at[k + 1]].split(b"\n"):
            if place not in gone:
                lines.append(line)
            place += len(line) + 1
        out.append(b"\n".join(lines).decode())
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nav_marks: int = 3, boilerplate_words: int = 20, with_text: bool = True) -> DataFrame:
    """A row per document: base counts, line counts, verdict and, unless left out, the text without its bad lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tv.utf8(batch.column(1))
            for a, b in tv.blocks(at):
                part, off = data[at[a] : at[b]], at[a : b + 1] - at[a]
                got = _judge(part, off, nav_marks, boilerplate_words)
                texts = pa.array(_clean(part, off, got["bad_spans"]), pa.string()) if with_text else pa.nulls(b - a, pa.string())
                flags = [pa.array(got[c], pa.bool_()) for c in ("base_failed", "kept")]
                counts = [pa.array(got[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "kept_chars")]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *counts, *flags, texts], names=[f.partition(" ")[0] for f in SCHEMA.split(", ")])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = chosen.mapInArrow(run, SCHEMA)
    return out if with_text else out.drop("clean_text")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns, their text without its bad lines. One pass, no shuffle."""
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # whatever the columns are called
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tv.utf8(batch.column(text_at))
            for a, b in tv.blocks(at):
                part, off = data[at[a] : at[b]], at[a : b + 1] - at[a]
                got = _judge(part, off, 3, 20)
                columns = [c[a:b] for c in batch.columns]
                columns[text_at] = pa.array(_clean(part, off, got["bad_spans"]), batch.schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(got["kept"], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
grams AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY k),
lines AS (SELECT k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS marks, length(regexp_replace(line, '[^|]', '', 'g')) AS bars
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t)),
judged AS (SELECT *, n > 0 AND ((bars >= 3 AND 3 * bars >= n) OR 10 * marks > chars OR (n <= 2 AND NOT regexp_matches(line, '[.!?":;][\x20\x09-\x0D]*$'))
  OR (n <= 20 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '@PHRASES@'))) AS bad FROM lines),
per AS (SELECT k, count(*) AS n_lines, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines,
  coalesce(sum(chars) FILTER (NOT bad), 0)::BIGINT AS kept_chars, sum(chars)::BIGINT AS word_chars, sum(marks)::BIGINT AS n_symbols FROM judged GROUP BY k),
counted AS (SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, n_lines, n_bad_lines, kept_chars
  FROM w JOIN per USING (k) LEFT JOIN covered c USING (k)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 2 * kept_chars >= word_chars AS kept FROM based
""".replace("@PHRASES@", "|".join(BOILERPLATE))
