"""Line dedup: repeated runs of lines by a suffix array over line ids, and the deletion of their later copies.

The suffixes of all line sequences are sorted into intervals by prefixes of 1, 2, 4, ... lines, until no
interval has two members. A rank is the earliest position of the equal prefix, so the suffixes of one rank
are one interval of the suffix array whose common prefix is at least that long. Back down the lengths,
each position then learns the longest common prefix that it has with any earlier one: an interval is
split by the next half as many lines, whoever finds an earlier member in its part goes on there, the part's
earliest member stays in the interval for the others. Positions whose longest common prefix reaches further
than that of the position before begin the maximal repeated runs.

Texts that are equal as a whole are one sequence: the first stands for them, the others are later copies
from their first line to their last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Text, blocks, dropped, free, get, kept, of_rows, plain, run_hashes, whole_ids, words

#: Lines that a run has at least; a single line counts from LONE_WORDS words.
MIN_LINES, LONE_WORDS = 2, 10


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, dk, th) of docs: dk is the id, a null one the smallest, th a hash that tells texts of one id apart."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.expr("-9223372036854775807L - 1L"))
    return whole_ids(docs).select("doc_id", "text", key.alias("dk"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def cut_lines(text: Text) -> tuple:
    """Starts and ends of all non-blank lines without outer white space, their first per row, number of words, and where the whole line begins and ends."""
    b = text.bytes
    white = SPACE[b] if len(b) else np.zeros(0, bool)
    ws, we = words(~white, text.offsets)
    ls, le = words(b != 10 if len(b) else np.zeros(0, bool), text.offsets)
    w1, w2 = of_rows(ws, ls), of_rows(ws, le)
    some = w2 > w1
    ls, le, w1, w2 = ls[some], le[some], w1[some], w2[some]
    return ws[w1] if len(w1) else ls, we[w2 - 1] if len(w2) else le, of_rows(ls, text.offsets), w2 - w1, ls, le


def _line_table(docs: DataFrame) -> DataFrame:
    """(dk, th, tg, i, a, b, words) of each line that is not blank; tg is another hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            text = Text(get(batch, "text"))
            s, e, first, n_words, _, _ = cut_lines(text)
            row = np.repeat(np.arange(text.n), np.diff(first))
            own = [get(batch, c).to_numpy()[row] for c in ("dk", "th", "tg")]
            cols = [*own, (np.arange(len(s)) - first[row]).astype(np.int32), run_hashes(text.bytes, s, e).view(np.int64), run_hashes(text.bytes, s, e, 0xC2B2AE3D27D4EB4F).view(np.int64), np.minimum(n_words, 1 << 30).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dk", "th", "tg", "i", "a", "b", "words"])

    named = docs.select("dk", "th", F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("tg"), "text")
    return named.mapInArrow(run, "dk bigint, th bigint, tg bigint, i int, a bigint, b bigint, words int")


AT = ("dk", "th", "i")


def _grouped(table: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """(dk, th, i, extra, r) of the rows whose keys are there twice or more; r is the earliest position. Counting has a partial step. The ranks are
    written before they are joined: beside an aggregate of the same stage a hot key's rows could not be split."""
    ranks = kept(table.groupBy(*keys).agg(F.min(F.struct(*AT)).alias("r"), F.count("*").alias("many")).where("many > 1").drop("many"), "heads")
    renamed = ranks.withColumnsRenamed({k: f"{k}_" for k in keys})
    out = kept(table.join(renamed, [F.col(k) == F.col(f"{k}_") for k in keys]).select(*AT, *extra, "r"), "ranks")
    dropped(ranks)
    return out


def _ahead(rows: DataFrame, ranks: DataFrame, by: F.Column) -> DataFrame:
    """rows with q, the rank that ranks has for the position `by` lines further on in the same text; rows without one are left out."""
    right = ranks.select(F.col("dk").alias("dk2"), F.col("th").alias("th2"), F.col("i").alias("i2"), F.col("r").alias("q"))
    return rows.join(right, (F.col("dk") == F.col("dk2")) & (F.col("th") == F.col("th2")) & (F.col("i") + by == F.col("i2"))).drop("dk2", "th2", "i2")


def _flat(rows: DataFrame, *extra: str) -> DataFrame:
    """rows with the fields of the ranks g and q as columns to group by."""
    return rows.select(*AT, *extra, *[F.col(f"{x}.{k}").alias(f"{x}{k}") for x in ("g", "q") for k in AT])


PAIR = [f"{x}{k}" for x in ("g", "q") for k in AT]


def doubled(lines: DataFrame) -> list[DataFrame]:
    """Ranks (dk, th, i, r) by prefixes of 1, 2, 4, ... lines, of the positions that share theirs; the last table has rows, and no longer prefix is shared."""
    levels = [_grouped(lines, ["a", "b"], ["words"])]
    while True:
        now = levels[-1]
        both = kept(_flat(_ahead(now.select(*AT, F.col("r").alias("g")), now, F.lit(1 << (len(levels) - 1)))), "pairs")
        found = _grouped(both, PAIR, [])
        dropped(both)
        if found.isEmpty():
            dropped(found)
            return levels
        levels.append(found)


def earlier_runs(levels: list[DataFrame], least: int) -> DataFrame:
    """(dk, th, i, n): the longest n, of `least` lines or more, for which the n lines from that position on begin earlier too. levels: from doubled().

    rows: an interval of n lines (its rank g) and the positions in it that ask, or (ask false) stand for a part of it.
    """
    here = F.struct(*AT)
    rows, done = None, []
    for j in reversed(range(len(levels))):
        parts = []
        if rows is not None:
            tested = kept(_flat(_ahead(rows, levels[j], F.col("n")), "n", "ask"), "tested")
            found = _grouped(tested, [*PAIR, "n"], ["n", "ask"])
            dropped(tested)
            later = here > F.col("r")
            moved = found.select(*AT, (F.col("n") + (1 << j)).alias("n"), (F.col("ask") & later).alias("ask"), F.col("r").alias("g"))
            # who found an earlier one leaves; the earliest of a part stays
            left = found.where(later).select(*[F.col(k).alias(f"{k}_") for k in AT], F.col("n").alias("n_"))
            stay = rows.join(left, [*(F.col(k) == F.col(f"{k}_") for k in AT), F.col("n") == F.col("n_")], "left_anti")
            parts += [moved, stay.select(*AT, "n", "ask", "g")]
        if (2 << j) > least:  # shorter prefixes cannot grow to that many lines
            own = levels[j].select(*AT, "r")
            if j + 1 < len(levels):
                over = levels[j + 1].where(here > F.col("r")).select(*[F.col(k).alias(f"{k}_") for k in AT])
                own = own.join(over, [F.col(k) == F.col(f"{k}_") for k in AT], "left_anti")
            parts.append(own.select(*AT, F.lit(1 << j).alias("n"), (here > F.col("r")).alias("ask"), F.col("r").alias("g")))
        if not parts:
            continue
        before, rows = rows, parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = kept(rows, "intervals")
        if before is not None:
            dropped(before, found)
    if rows is None:
        return levels[0].where("false").select(*AT, F.lit(1).alias("n"))
    return rows.where("ask").where(F.col("n") >= least).select(*AT, "n")


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, lone_words: int = LONE_WORDS) -> DataFrame:
    """(dk, th, gone) of docs from keyed(): of each text with later copies, `gone` has the first line and length of its maximal repeated runs (run
    true) and of its single lines that go, by number among the lines that are not blank; i = -1 stands for all lines."""
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    lines = kept(_line_table(docs), "lines")
    texts = lines.where("i = 0").select("dk", "th", "tg")
    same = texts.groupBy("th", "tg").agg(F.min("dk").alias("least"), F.max("dk").alias("most")).where("least < most").select(F.col("th").alias("th2"), F.col("tg").alias("tg2"), "least")
    copies = kept(texts.join(same, (F.col("th") == F.col("th2")) & (F.col("tg") == F.col("tg2"))).where("dk > least").select("dk", "th").distinct(), "copies")
    own = lines.join(copies.select(F.col("dk").alias("dk_"), F.col("th").alias("th_")), (F.col("dk") == F.col("dk_")) & (F.col("th") == F.col("th_")), "left_anti")
    own = own.select(*AT, "a", "b", "words")
    if not texts.groupBy("dk", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        own = own.dropDuplicates(AT)  # repeated rows are one text
    slim = kept(own, "own")
    levels = doubled(slim)
    later = F.struct(*AT) > F.col("r")
    lone = levels[0].where(later).where(F.col("words") >= lone_words).select(*AT, F.lit(1).alias("n"), F.lit(False).alias("run"))
    runs = kept(earlier_runs(levels, min_lines), "runs")
    before = F.lag(F.col("i") + F.col("n")).over(W.partitionBy("dk", "th").orderBy("i"))
    runs = runs.withColumn("reach", before).where(F.col("reach").isNull() | (F.col("i") + F.col("n") > F.col("reach"))).select(*AT, "n", F.lit(True).alias("run"))
    # a copy of a whole text: a run if it is long enough, else its single line goes if that is long enough
    whole = lines.join(copies.select(F.col("dk").alias("dk_"), F.col("th").alias("th_")), (F.col("dk") == F.col("dk_")) & (F.col("th") == F.col("th_")))
    whole = whole.groupBy("dk", "th").agg(F.max("i").alias("i"), F.max("words").alias("words")).withColumn("n", F.col("i") + 1)
    whole = whole.where((F.col("n") >= min_lines) | (F.col("words") >= lone_words)).select("dk", "th", F.when(F.col("n") >= min_lines, -1).otherwise(0).alias("i"), "n", (F.col("n") >= min_lines).alias("run"))
    gone = kept(lone.unionByName(runs).unionByName(whole).groupBy("dk", "th").agg(F.collect_set(F.struct("i", "n", "run")).alias("gone")), "gone")
    dropped(lines, copies, slim, *levels)
    return gone


def stripped(docs: DataFrame, min_lines: int = MIN_LINES, lone_words: int = LONE_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """docs with the later copies cut out of text, and further columns: lines, removed, runs, longest, bytes; with their names, which are free in docs.

    A line is text between line feeds; outer white space does not count when lines are compared, and
    blank lines neither count nor go. A line goes if it lies in a run of at least `min_lines` lines that
    begins earlier too, in a smaller doc_id or further up in the same text, or by itself has at least
    `lone_words` words and is there earlier. runs counts the maximal ones of these runs, longest is the lines
    of the longest. A null text has no lines and stays null. A null id is the smallest; an id that is not an
    integer is an error. Rows alike in id and text are the same document and not each other's copies.
    """
    from pyspark.sql import types as T

    names = docs.columns
    dk, th, dk2, th2, gone, *new = free(names, "dk", "th", "dk2", "th2", "gone", "lines", "removed", "runs", "longest", "bytes")
    found = later_copies(keyed(docs), min_lines, lone_words).select(F.col("dk").alias(dk2), F.col("th").alias(th2), F.col("gone").alias(gone))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.expr("-9223372036854775807L - 1L"))
    own = docs.withColumns({dk: key, th: F.xxhash64(F.coalesce("text", F.lit("")))})
    met = own.join(found, (F.col(dk) == F.col(dk2)) & (F.col(th) == F.col(th2)), "left").select(*plain(docs), gone)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            column = get(batch, "text")
            text = Text(column)
            _, _, first, _, ls, le = cut_lines(text)
            texts, null = [], column.is_null().to_pylist()
            removed, runs, longest = (np.zeros(text.n, np.int64) for _ in range(3))
            for r, cuts in enumerate(get(batch, gone).to_pylist()):
                raw = text.row(r)
                if cuts:
                    drop = np.zeros(int(first[r + 1] - first[r]) + 1, np.int64)
                    for c in cuts:
                        drop[max(c["i"], 0)] += 1
                        drop[max(c["i"], 0) + c["n"]] -= 1
                        runs[r] += c["run"]
                        longest[r] = max(longest[r], c["n"] * c["run"])
                    drop = np.cumsum(drop[:-1]) > 0
                    removed[r] = drop.sum()
                    at, out = 0, []
                    for k in np.flatnonzero(drop).tolist():  # a line goes with the line feed after it, the last one with that before it
                        s, e = int(ls[first[r] + k] - text.offsets[r]), int(le[first[r] + k] - text.offsets[r])
                        out.append(raw[at:s])
                        at = e + 1
                    out.append(raw[at:])
                    joined = b"".join(out)
                    raw = joined[:-1] if at > len(raw) and joined.endswith(b"\n") else joined
                texts.append(None if null[r] else raw.decode())
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(k) for k, c in enumerate(names)]
            more = [np.diff(first).astype(np.int64), removed, runs, longest, np.diff(text.offsets)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x) for x in more)], [*names, *new])

    return met.mapInArrow(run, schema), dict(zip(("lines", "removed", "runs", "longest", "bytes"), new))


def report(docs: DataFrame, min_lines: int = MIN_LINES, lone_words: int = LONE_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, longest_run, kept_sha256 of each document."""
    out, c = stripped(docs.select("doc_id", "text"), min_lines, lone_words)
    return out.select("doc_id", F.col(c["lines"]).alias("n_lines"), F.col(c["removed"]).alias("n_removed"), F.col(c["runs"]).alias("n_runs"), F.col(c["longest"]).alias("longest_run"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without later copies of line runs; a document of which nothing else is left goes. n_chars follows the text."""
    out, c = stripped(docs)
    out = out.where((F.col(c["removed"]) < F.col(c["lines"])) | (F.col(c["lines"]) == 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*plain(docs))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '^[ \t\v\f\r]+', ''), '[ \t\v\f\r]+$', '') AS key FROM l),
f AS MATERIALIZED (SELECT doc_id, pos, key, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, len(regexp_extract_all(key, '[^ \t\v\f\r]+')) AS w FROM k WHERE key <> ''),
m AS (SELECT x.doc_id, x.i, y.doc_id AS d2, x.i - y.i AS diagonal FROM f x JOIN f y ON x.key = y.key AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.i < x.i)),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d2, diagonal ORDER BY i) AS island FROM m),
e AS (SELECT doc_id, i, max(last) AS last FROM (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id, d2, diagonal, island) AS last FROM s) GROUP BY doc_id, i),
r AS (SELECT *, last > i AND last > coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY i), 0) AS head, max(last) FILTER (last > i) OVER (PARTITION BY doc_id ORDER BY i) AS reach FROM e),
g AS (SELECT f.doc_id, f.pos, coalesce(r.i IS NOT NULL AND (f.w >= 10 OR r.reach >= f.i), false) AS gone, coalesce(head, false) AS head, r.last - r.i + 1 AS n FROM f LEFT JOIN r ON r.doc_id = f.doc_id AND r.i = f.i),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_runs, coalesce(max(n) FILTER (head), 0) AS longest_run FROM g GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY k.pos) AS text FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.pos = g.pos
      WHERE NOT coalesce(g.gone, false) GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(n.n_removed, 0) AS n_removed, coalesce(n.n_runs, 0) AS n_runs, coalesce(n.longest_run, 0) AS longest_run,
  sha256(coalesce(t.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def brute(docs: list, min_lines: int = MIN_LINES, lone_words: int = LONE_WORDS, texts: dict | None = None) -> list[tuple]:
    """The report by plain Python, for tests. Rows alike in id and text are to be given once. texts, where given, takes what is left of each text by id."""
    import re

    rows = sorted(((i, (t or "").split("\n")) for i, t in docs), key=lambda x: (x[0] is not None, x[0] or 0))
    seen: set = set()
    out = []
    strip = " \t\v\f\r"
    for i, lines in rows:
        own = [(k, x.strip(strip)) for k, x in enumerate(lines) if x.strip(strip)]
        keys = [x for _, x in own]
        long = []
        for j in range(len(keys)):
            n = 0
            while j + n < len(keys) and tuple(keys[j : j + n + 1]) in seen:
                n += 1
            long.append(n)
            for m in range(j + 1):  # the runs that end here begin at or before j; later positions may know them
                seen.add(tuple(keys[m : j + 1]))
        # runs further up in the same text may go on past the position that repeats them
        for j in range(len(keys)):
            for q in range(j):
                n = 0
                while j + n < len(keys) and keys[q + n] == keys[j + n]:
                    n += 1
                long[j] = max(long[j], n)
        heads = [j for j, n in enumerate(long) if n >= min_lines and (j == 0 or long[j - 1] <= n)]
        gone = [n >= 1 and len([w for w in re.split("[ \t\v\f\r]+", x) if w]) >= lone_words for n, x in zip(long, keys)]
        for j in heads:
            gone[j : j + long[j]] = [True] * long[j]
        drop = {own[j][0] for j in range(len(own)) if gone[j]}
        left = "\n".join(x for k, x in enumerate(lines) if k not in drop)
        if texts is not None:
            texts[i] = left
        out.append((i, len(own), len(drop), len(heads), max((long[j] for j in heads), default=0), hashlib.sha256(left.encode()).hexdigest()))
    return out
