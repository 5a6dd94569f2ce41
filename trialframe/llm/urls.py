"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of

#: Default rules: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled URL table is made by ``labelled`` of plain English words for what sites are about: those to be blocked and the others.
#: The words come from no URL of any data; a few dozen of them are an example of such a table, and no substitute for a real list.
BLOCKED = """casino poker betting slots jackpot lottery roulette bingo wager blackjack gambling bookmaker
 pills viagra steroids tablets slimming painkillers diet prescription adult porn xxx sex nude escort webcam singles
 warez crack keygen torrent pirated serial malware phishing trojan spyware ransomware botnet
 payday loans cash bitcoin doubler scam forex investment replica fake counterfeit followers likes backlinks spam adserver popup banner clickbait tracker""".split()
HARMLESS = """university college school library museum science history nature news weather travel recipes garden music theatre cinema
 football cycling hiking swimming health hospital doctor dentist council government parliament court police harbour river mountain forest village
 city market bakery florist bookshop tailor carpenter plumber painter teacher student research journal article review encyclopedia dictionary
 language grammar maths physics chemistry biology astronomy geology software programming manual forum community charity church festival concert
 orchestra gallery railway airport hotel restaurant kitchen furniture clothing shoes bicycle camera computer telephone insurance accounting architect engineer farm horse""".split()


def labelled() -> list[tuple[str, int]]:
    """Three hosts for each word, alone and with other words of its kind; both kinds get the same paths, so paths tell nothing."""
    paths, rows = ("/", "/about", "/page/3", "/item?id=4", "/2021/05/list.html"), []
    for kind, words in ((1, BLOCKED), (0, HARMLESS)):
        for i, word in enumerate(words):
            near, far = words[(i + 3) % len(words)], words[(i + 7) % len(words)]
            rows += [(f"{'http' if k % 2 else 'https'}://{host}{paths[(i + k) % len(paths)]}", kind) for k, host in enumerate((f"{word}.test", f"www.{word}-{far}.example", f"{near}{word}.test"))]
    return rows


DIMENSIONS = 1 << 15


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for a null or a text without ``://``."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    end = re.search(r"[/?#]", rest)
    cut = end.start() if end else len(rest)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split(r"[?#]", rest[cut:], maxsplit=1)[0]


def grams(host: str, path: str, sizes: Sequence[int] = (3, 4, 5)) -> np.ndarray:
    """Indices of the hashed character n-grams of host and path; each field has its own marker."""
    found = []
    for text in (f"h^{host}$", f"p^{path}$"):
        found += [zlib.crc32(f"{text[0]}{text[i : i + n]}".encode()) % DIMENSIONS for n in sizes for i in range(1, len(text) - n + 1)]
    return np.unique(np.array(found, dtype=np.int64))


def train(table: Sequence[tuple[str, int]], rounds: int = 1000, rate: float = 4.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the table, over the n-grams that it has; the same table gives the same model."""
    rows = [grams(*split_url(u)) for u, _ in table]
    y = np.array([v for _, v in table], dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    used, at = np.unique(np.concatenate(rows), return_inverse=True)
    value = np.concatenate([np.full(len(x), 1 / np.sqrt(max(1, len(x)))) for x in rows])
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both labels weigh alike
    w, b = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        error = share * (1 / (1 + np.exp(-(np.bincount(row, value * w[at], minlength=len(y)) + b))) - y)
        w -= rate * (np.bincount(at, value * error[row], minlength=len(w)) + l2 * w)
        b -= rate * error.sum()
    out = np.zeros(DIMENSIONS)
    out[used] = w
    return out, b


@cache
def default_model() -> tuple[np.ndarray, float]:
    return train(labelled())


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str]]], lengths: Sequence[int]) -> tuple[str | None, str | None]:
    """(rule, action) of the longest rule whose host is ``host`` or a parent domain and whose path starts ``path``; ``lengths`` are those of the rules' hosts."""
    best: tuple[int, int, str, str] | None = None
    for n in lengths:
        if n == len(host) or n < len(host) and host[-n - 1] == ".":
            name = host[len(host) - n :]
            for start, action in rules.get(name, ()):
                if path.startswith(start):
                    best = max(best or (0, 0, "", ""), (len(name) + len(start), len(name), name + start, action))
    return (best[2], best[3]) if best else (None, None)


def url_filter(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: Sequence[tuple[str, str, str]] = RULES, model: tuple[np.ndarray, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep``, host, path, rule, verdict and the model's score of every row.

    A rule fits its host and all subdomains when the path starts with the rule's; the longest wins
    (on equal length the longer host).  Rows without a rule get the model's verdict.  A null or
    malformed URL has an empty host and path and goes to the model.  Rows are independent: nothing
    is shuffled, repeated rows and null ids are rows like others, an empty table gives none.  Rules
    are looked up by parent domains of their hosts' lengths, so their number doesn't slow a row.  ``keep`` must not name a
    column that is added (ValueError); other columns are not looked at, whatever their names.
    """
    clear_of(keep, "host", "path", "rule", "verdict", "score")
    weights, bias = model or default_model()
    by_host: dict[str, list[tuple[str, str]]] = {}
    for action, host, path in rules:
        by_host.setdefault(host, []).append((path, action))
    lengths = sorted({len(h) for h in by_host if h})
    sent = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), by_host))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, known = sent.value
        for b in it:
            rows = []
            for u in b["__url"]:
                host, path = split_url(u)
                own = grams(host, path)
                score = float(1 / (1 + np.exp(-(w[own].sum() / np.sqrt(max(1, len(own))) + bias))))
                rule, action = rule_for(host, path, known, lengths)
                rows.append((host, path, rule, action or ("block" if score >= threshold else "allow"), score))
            yield pd.concat([b.drop(columns="__url"), pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "score"])], axis=1)

    kept = df.select(*keep, F.col(url).alias("__url"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "host string, path string, rule string, verdict string, score double"])
    return kept.mapInPandas(batches, schema)
