"""Personal data: fixed patterns find seeds, bootstrapped contexts find more.

Seeds are e-mail addresses, IP addresses, card and phone numbers.  The words before an entity are
its patterns.  Patterns and instances (texts of entities and of identifier-like words) form a
graph that Spark scores in turns: a pattern is as good as its instances, an instance as good as
its patterns.  Identifier-like words behind patterns of high confidence are reported too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, clear_of, discard, small_batches, written

KINDS = ("email", "ip", "card", "phone", "other")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Identifier-like: six characters or more, four digits or more.
_CANDIDATE = re.compile(r"(?<![^\s\"'=:(\[])[A-Za-z0-9](?:[A-Za-z0-9_./-]*[A-Za-z0-9])?")
_WORD_BEFORE = re.compile(r"\S+")
#: Longer words before an entity go by a checksum.
LONG_WORD = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, sorted; per kind leftmost and not overlapping.

    Every scan is linear in the text: an address is looked for from its @, and a match that fails
    its test is dropped with all its characters.
    """
    found = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            found.append((start, 0, last))
            at = text.find("@", last)
        else:
            last = max(last, at)
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class Before:
    """The words before places that are asked in ascending order; the text is read once in all.

    A word of more than LONG_WORD characters goes by its length and a running checksum.
    """

    def __init__(self, text: str) -> None:
        self.text, self.words = text, _WORD_BEFORE.finditer(text)
        self.last: list[str] = []  # the last two words that end before the place
        self.now: tuple[int, int] | None = None  # the word that the place is in or before
        self.read, self.sum = 0, 0

    def _name(self, start: int, end: int) -> str:
        if end - start <= LONG_WORD:
            return self.text[start:end].lower()
        if not start <= self.read <= end:
            self.read, self.sum = start, 0
        self.sum = zlib.crc32(self.text[self.read : end].lower().encode("utf-8", "surrogatepass"), self.sum)
        self.read = end
        return f"{end - start}:{self.sum:08x}"

    def patterns(self, start: int) -> list[str]:
        """The last word, and the last two words, before ``start``."""
        while True:
            if self.now is None:
                m = next(self.words, None)
                self.now = m.span() if m else (len(self.text) + 1, 0)
            if self.now[0] > len(self.text) or self.now[1] > start:
                break
            self.last = [*self.last, self._name(*self.now)][-2:]
            self.now = None
        before = [*self.last, self._name(self.now[0], start)] if self.now[0] < start else self.last
        return [" ".join(before[-n:]) for n in (1, 2) if len(before) >= n]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, and identifier-like words that overlap none, with their patterns."""
    before = Before(text)
    found = [{"start": s, "end": e, "seed": True, "instance": text[s:e].lower(), "patterns": before.patterns(s)} for s, _, e in base]
    if any(c.isdigit() for c in text):
        k, reach, spans, before = 0, 0, base, Before(text)
        for m in _CANDIDATE.finditer(text):
            word = m[0]
            if len(word) < 6 or sum(c.isdigit() for c in word) < 4:
                continue
            while k < len(spans) and spans[k][0] < m.end():
                reach = max(reach, spans[k][2])
                k += 1
            if reach <= m.start():
                found.append({"start": m.start(), "end": m.end(), "seed": False, "instance": word.lower(), "patterns": before.patterns(m.start())})
    return found


_SCAN = "n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>"


def scan(docs: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep``, the counts and the joined base spans, and the candidates with their contexts, of every row."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for t in b["__text"]:
                t = t or ""
                base = base_spans(t)
                rows.append((*(sum(k == x for _, k, _ in base) for x in range(4)), joined(base), candidates(t, base)))
            yield pd.concat([b.drop(columns="__text"), pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "found"])], axis=1)

    kept = docs.select(*keep, F.col(text).alias("__text"))
    return kept.mapInPandas(batches, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), _SCAN]))


def confident_patterns(scanned: DataFrame, rounds: int = 3, least: float = 0.8, support: int = 5) -> DataFrame:
    """Patterns (column ``pattern``) whose score is at least ``least`` and that have ``support`` different seeds.

    A pattern scores the mean of its instances with one unknown instance added; an instance
    scores 1 if it is a seed, else noisy-or over its patterns of enough support.
    """
    edges = (
        scanned.select(F.explode("found").alias("x"))
        .select(F.explode("x.patterns").alias("pattern"), F.xxhash64("x.instance").alias("instance"), F.col("x.seed").cast("int").alias("seed"))
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"))
    )
    edges = written(edges, "pii-edges")
    belief = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("belief"))
    scored = None
    for k in range(rounds):
        scored = edges.join(belief, "instance").groupBy("pattern").agg((F.sum("belief") / (F.count("*") + 1)).alias("score"), F.sum("seed").alias("seeds"))
        if k + 1 < rounds:
            scored = written(scored, "pii-patterns")
            last, belief = belief, written(
                edges.join(scored, "pattern")
                .groupBy("instance")
                .agg(F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(F.sum(F.when(F.col("seeds") >= support, F.log(1 - F.col("score"))).otherwise(0.0)))).alias("belief")),
                "pii-belief",
            )
            discard(scored)
            if k:
                discard(last)
    return scored.where((F.col("score") >= least) & (F.col("seeds") >= support)).select("pattern")


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rounds: int = 3, least: float = 0.8, support: int = 5) -> DataFrame:
    """``keep``, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_found of every row.

    ``spans`` lists the base spans and, as kind ``other``, those that patterns add.  A null text is
    an empty one; rows may repeat, and null ids are rows like others: spans return to their row by
    a number given when the scan is written, never by id.  Only contexts are shuffled, and
    where the added spans exceed BROADCAST_ROWS the scan's rows, to meet them.  Texts of any length
    are scanned whole; an empty table gives no rows.  ``keep`` must not name a column that is added
    or used on the way (ValueError); other columns are not looked at, whatever their names.
    """
    clear_of(keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found", "base", "found", "__row", "__more")
    with small_batches(docs.sparkSession):
        scanned = written(scan(docs, keep, text).withColumn("__row", F.monotonically_increasing_id()), "pii-scan")
    accepted = confident_patterns(scanned, rounds, least, support)
    hits = (
        scanned.where(F.exists("found", lambda x: ~x["seed"]))
        .select("__row", F.explode(F.filter("found", lambda x: ~x["seed"])).alias("x"))
        .select("__row", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
        .join(accepted, "pattern", "left_semi")
        .groupBy("__row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__more"))
    )
    hits = written(hits, "pii-hits")
    few = (hits.agg(F.sum(F.size("__more"))).first()[0] or 0) <= BROADCAST_ROWS
    found = scanned.drop("found").join(F.broadcast(hits) if few else hits, "__row", "left")
    # starts are compared as numbers: the base spans are sorted already, and the added ones overlap none
    spans = F.when(F.col("__more").isNull(), F.col("base")).otherwise(_merged("base", "__more"))
    return found.select(*keep, "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("__more"), F.lit(0)).alias("n_found"))


def _merged(base: str, more: str):
    """Both lists of spans by start, joined as text."""
    own = F.transform(F.filter(F.split(base, ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.lit(0).alias("k"), x.alias("s")))
    new = F.transform(more, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("k"), F.concat_ws(":", F.lit("other"), x["start"].cast("string"), x["end"].cast("string")).alias("s")))
    # a stable order within equal starts: base spans come first, in their own order
    return F.array_join(F.transform(F.array_sort(F.concat(F.transform(own, lambda x, i: F.struct(x["start"].alias("start"), x["k"].alias("k"), i.alias("i"), x["s"].alias("s"))), F.transform(new, lambda x, i: F.struct(x["start"].alias("start"), x["k"].alias("k"), i.alias("i"), x["s"].alias("s"))))), lambda x: x["s"]), ",")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; spans that overlap become one, named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for x in spans.split(",") if spans else []:
        kind, s, e = x.split(":")
        if merged and int(s) < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], int(e))
        else:
            merged.append([kind, int(s), int(e)])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted():
    """A column function of text and spans, see ``redact``."""

    @F.pandas_udf("string")
    def out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact(t or "", s or "") for t, s in zip(texts, spans, strict=True)], dtype=object)

    return out
