"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest.

The regression is trained from a small table of labelled URLs (SEED_URLS, or one's own rows of url and block), which is made of
two lists of words and takes nothing from any table it is applied to;
features are the 3- to 5-grams of bytes of the marked host and path, hashed to 2**BITS weights. The bias is fixed at
PRIOR, so that what resembles nothing in the table is allowed. What the table has no words for, it does not find.

Null url, or one without '://': host and path are empty, no rule fits, and the verdict is that of the
regression on empty text. Rows come back as they are, repeated ones and null ids too. Empty table: no rows. Of rules of equal
length the last in order of text wins. Very long urls are taken whole. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._spark import table
from kgspark.llm._words import U, _bytes, buffer, mix, pieces, prefix, spans

BITS, SIZES, EPOCHS, RATE, RIDGE, PRIOR = 18, (3, 4, 5), 600, 8.0, 1e-5, -0.5

#: Verdict, host, path. The longest that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: The labelled table is made of names of these, from general knowledge of what filter lists are about: gambling, drugs, adult
#: content, fraud, pirated goods, advertising and malware; and of what other sites are about.
UNWANTED = """casino poker roulette blackjack jackpot slots betting bets bingo lottery gambling wager spins bookmaker
viagra cialis pharmacy pills steroids weightloss botox kratom vape
porn sex xxx adult escort nude fetish webcam erotic milf hookup singles dating
payday loans quickcash getrich forex bitcoin crypto investing profit moneymaker earnings giveaway prize winner freegift lucky
followers likes traffic backlinks seo linkfarm spam clickbait popup adserver ads banner tracker tracking affiliate doubleclick
torrent warez crack keygen serial nulled cheats hacked pirate replica fake counterfeit knockoff
phishing malware virus trojan login-verify account-update secure-signin password-reset unlocker hacktool cheap discount""".split()
HARMLESS = """news library museum university school college science physics biology chemistry history geography weather climate recipes cooking garden
forum community church charity council parliament court police hospital clinic health dentist nursing music concert theatre cinema gallery painting
poetry novel writing reading language grammar dictionary travel railway airport hotel hostel camping hiking mountain river ocean island harbour
football cricket tennis cycling running swimming chess puzzle knitting pottery woodwork bakery coffee restaurant farm orchard vineyard forest
engineering software hardware compiler database network robotics astronomy telescope satellite energy solar battery bridge architecture furniture
economy finance insurance bank accounting law tax pension jobs careers training teacher student kindergarten nature wildlife birds fishing
radio television podcast magazine journal archive encyclopedia map atlas calendar photo camera video design fashion shoes jewellery""".split()
#: Words and marks that go with either.
FILLERS = "online best free club shop world zone live top my the web city portal hub info new daily 24 365".split()
JOINTS = ("-", "", "-")
PATHS = """/ /index.html /about /home /en/ /fr/ /de/ /es/ /en/12 /fr/907 /de/44 /es/381 /2024/05/post /page/3 /tag/a /search /contact /guide/intro /album/7 /item/5521""".split()


def seed_urls(unwanted: Iterable[str] = UNWANTED, harmless: Iterable[str] = HARMLESS) -> tuple[tuple[str, int], ...]:
    """Of each word its bare name and four with a filler, before or after it; addresses are alike for both kinds."""
    out = []
    for block, names in ((1, unwanted), (0, harmless)):
        for i, name in enumerate(names):
            for turn in range(5):
                n = 7 * i + 3 * turn
                filler, joint = FILLERS[n % len(FILLERS)], JOINTS[n % len(JOINTS)]
                site = name if turn == 0 else name + joint + filler if turn % 2 else filler + joint + name
                scheme, front, end = ("http", "https")[n % 2], ("", "www.", "m.", "blog.")[n // 2 % 4], ("com", "net", "org", "example.com", "example.org")[n % 5]
                out.append((f"{scheme}://{front}{site}.{end}{PATHS[n % len(PATHS)]}", block))
    return tuple(out)


SEED_URLS = seed_urls()


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls; of equally long ones, the last in order of text."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def features(urls: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of marked host-and-path strings: each n-gram's weight index and its row."""
    buf, off = buffer(urls)
    sums = prefix(buf.astype(U) + U(1), _bytes)
    index, row = [], []
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for n in SIZES:
        at = np.flatnonzero(np.arange(len(buf)) + n <= np.repeat(off[1:], np.diff(off)))
        index.append((mix(spans(sums, at, at + n, _bytes) + U(n)) >> U(64 - bits)).astype(np.int64))
        row.append(rows[at])
    return np.concatenate(index), np.concatenate(row)


def logits(weights: np.ndarray, bias: float, index: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(np.bincount(row, minlength=n), 1)
    return bias + np.bincount(row, weights[index], n) / np.sqrt(size)


def train(labelled: Iterable[tuple[str, int]] = SEED_URLS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Gradient descent over all rows. labelled: url, 1 to block. Rows with a null are left out."""
    pairs = [(marked_url(u), y) for u, y in labelled if u is not None and y is not None]
    if not pairs:
        return np.zeros(1 << bits), PRIOR
    y = np.array([p[1] for p in pairs], float)
    index, row = features(pa.array([p[0] for p in pairs], pa.string()), bits)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    weights, bias = np.zeros(1 << bits), PRIOR
    for _ in range(EPOCHS):
        off = 1 / (1 + np.exp(-logits(weights, bias, index, row, len(y)))) - y
        weights -= RATE * (np.bincount(index, (off * scale)[row], 1 << bits) / len(y) + RIDGE * weights)
    return weights, bias


def marked_url(url: str) -> str:
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "\x02" + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]) + "\x03" + path + "\x04"


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: Iterable[tuple[str, int]] = SEED_URLS) -> DataFrame:
    """id_col, host, path, rule, verdict and the regression's score (that it is to be blocked) of each row."""
    weights, bias = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "url_marked", 1 << 20):
            index, row = features(b.column("url_marked"))
            score = 1 / (1 + np.exp(-logits(weights, bias, index, row, b.num_rows)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("said"), F.concat(F.lit("\x02"), "host", F.lit("\x03"), "path", F.lit("\x04")).alias("url_marked"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, said string, score double")
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
