"""Secrets in texts: three fixed patterns, and strings that a character model takes for random.

Two first-order Markov chains over characters, one trained on random strings and one on ordinary
identifiers, score every long token; the span of a token whose log-likelihood ratio per character is
above the threshold is added. Base spans are cut out of a token first, and what is left of it is judged
piece by piece, so the rest of a secret that a base pattern found in part is not left behind. Training counts character pairs of labelled
samples; scanning is done in columns. Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import keyed, written

#: Fixed patterns. Of `assign` and `access` shorter matches are dropped after the search, as they use up text;
#: a run of hexadecimal digits that is too short holds no longer one, so its length stands in the pattern.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = "^(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the character models judge.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Fewest characters of a piece of a token that a base span was cut out of.
LEAST_PIECE = 8
#: Characters of the models; all others are one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of the leftmost matches that do not overlap, in code points.

    What lies between matches and the matches themselves alternate, so lengths give places.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, end: int, text: string>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["a"])
        end = start + F.length(x["b"])
        span = F.struct(start.alias("start"), end.alias("end"), x["b"].alias("text"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = F.aggregate(pairs, zero, step, lambda s: s["out"])
    # most texts hold no match, and finding none is much the cheaper way to know
    return F.when(text.rlike(pattern), out).otherwise(zero["out"])


def _base(text: Column) -> dict[str, Column]:
    value = lambda x: F.regexp_replace(x["text"], ASSIGN_HEAD, "")
    return {
        "assign": F.filter(_matches(text, ASSIGN), lambda x: F.length(value(x)) >= 8),
        "access": F.filter(_matches(text, ACCESS), lambda x: F.length(x["text"]) >= 16),
        "hex": _matches(text, HEX),
    }


@dataclass(frozen=True)
class CharacterModels:
    """Log-likelihood ratio (random over ordinary) of each pair of characters, SIZE x SIZE, row by row."""

    ratios: tuple[float, ...]
    threshold: float = 0.5

    def random(self, token: Column) -> Column:
        """Whether the ratio per character pair of a token is above the threshold."""
        # a character's place in the alphabet, 1-based, 0 for others
        places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) * (F.length(c) > 0).cast("int"))
        score = F.aggregate(
            places, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda a, c: F.struct(
                c.alias("last"),
                (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise(F.get(self._table(), a["last"] * SIZE + c))).alias("sum"),
            ),
            lambda a: a["sum"],
        )
        return score > self.threshold * (F.length(token) - 1)

    def _table(self) -> Column:
        return F.lit(list(self.ratios))


def train(samples: DataFrame, smoothing: float = 0.5, prior: float = 20.0, threshold: float = 0.5) -> CharacterModels:
    """From labelled samples (token, secret: boolean); null tokens or labels do not count.

    Pairs are counted within tasks before the shuffle, and there are at most 2 x SIZE x SIZE of them.
    Without samples of both kinds the models judge nothing random.
    """
    import math

    place = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = samples.where("token IS NOT NULL AND secret IS NOT NULL AND length(token) > 1").select(
        "secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.col("token").substr(i, F.lit(2)))).alias("pair")
    )
    coded = pairs.select("secret", place(F.substring("pair", 1, 1)).alias("x"), place(F.substring("pair", 2, 1)).alias("y"))
    counts = {True: [[0] * SIZE for _ in range(SIZE)], False: [[0] * SIZE for _ in range(SIZE)]}
    for secret, x, y, n in coded.groupBy("secret", "x", "y").count().collect():
        counts[secret][x][y] += n
    if not all(any(map(any, c)) for c in counts.values()):
        return CharacterModels((0.0,) * (SIZE * SIZE), threshold)

    alone = {k: [sum(row[y] for row in c) + smoothing for y in range(SIZE)] for k, c in counts.items()}

    def chance(kind: bool, x: int, y: int) -> float:
        """Of y after x; the less is known of x, the more y's own frequency counts."""
        row = counts[kind][x]
        return (row[y] + prior * alone[kind][y] / sum(alone[kind])) / (sum(row) + prior)

    ratios = tuple(round(math.log(chance(True, x, y) / chance(False, x, y)), 6) for x in range(SIZE) for y in range(SIZE))
    return CharacterModels(ratios, threshold)


def labelled_samples(docs: DataFrame) -> DataFrame:
    """token, secret: values that the base patterns find, and ordinary identifiers.

    Ordinary are runs of 8 letters, digits, _ and - or more, outside base spans, that hold a letter
    and at most one digit in four characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = _base(text)
    secret = F.concat(
        F.transform(base["assign"], lambda x: F.regexp_replace(x["text"], ASSIGN_HEAD, "")),
        F.transform(base["access"], lambda x: x["text"]), F.transform(base["hex"], lambda x: x["text"]),
    )
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.filter(
        F.regexp_extract_all(rest, F.lit("[A-Za-z0-9_-]{8,}"), F.lit(0)),
        lambda x: x.rlike("[A-Za-z]") & (4 * F.length(F.regexp_replace(x, "[^0-9]", "")) <= F.length(x)),
    )
    tag = lambda tokens, is_secret: F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(is_secret).alias("secret")))
    return docs.select(F.explode(F.concat(tag(secret, True), tag(plain, False))).alias("s")).select("s.*")


def found_spans(docs: DataFrame, models: CharacterModels, text: str = "text", into: str = "found") -> DataFrame:
    """All rows and columns, and the array `into` of (kind, start, end), ordered by start, then kind as in KINDS.

    A null text is empty. Ends are exclusive; places count code points.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = _base(whole)
    ranked = lambda spans, k: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))
    certain = F.concat(*(ranked(base[kind], k) for k, kind in enumerate(KINDS[:3])))

    def pieces(x: Column, known: Column) -> Column:
        """What base spans leave of a token: all of it, if none touches it."""
        inside = F.filter(known, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        stops = F.concat(inside, F.array(F.struct(x["end"].alias("start"), F.lit(0).alias("k"), x["end"].alias("end"))))
        zero = F.struct(x["start"].alias("at"), F.expr("CAST(array() AS array<struct<start: int, end: int, text: string>>)").alias("out"))

        def step(state: Column, b: Column) -> Column:
            text = F.substring(x["text"], state["at"] - x["start"] + 1, F.greatest(b["start"] - state["at"], F.lit(0)))
            piece = F.array(F.struct(state["at"].alias("start"), b["start"].alias("end"), text.alias("text")))
            out = F.when(b["start"] - state["at"] >= LEAST_PIECE, F.concat(state["out"], piece)).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], b["end"]).alias("at"), out.alias("out"))

        return F.aggregate(stops, zero, step, lambda state: state["out"])

    def add(known: Column) -> Column:
        judged = F.flatten(F.transform(_matches(whole, TOKEN), lambda x: pieces(x, known)))
        return F.sort_array(F.concat(known, ranked(F.filter(judged, lambda x: models.random(x["text"])), 3)))

    return docs.select("*", F.explode(F.transform(F.array(F.sort_array(certain)), add)).alias(into))


def _listed(spans: Column) -> Column:
    kind = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["k"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def trained_on(docs: DataFrame) -> CharacterModels:
    return train(written(labelled_samples(docs).groupBy("token", "secret").count().select("token", "secret"), "secret-samples"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document with an id; models learn from docs.

    A null text is empty; a repeated row is scanned as often as it occurs.
    """
    docs = keyed(docs, "doc_id", text="text")
    rows = found_spans(docs, trained_on(docs))
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    base = F.filter("found", lambda x: x["k"] < 3)
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
    )


def masked_documents(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of docs, with all their columns; every found span of the text gives way to the mask, n_chars follows.

    Overlapping spans give way to one mask. Rows without a secret stay as they are.
    """
    models, own = trained_on(docs.select("text")), "found"
    while own in docs.columns:
        own += "_"

    def cut(spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, x: Column) -> Column:
            piece = F.col("text").substr(a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
            out = F.when(x["start"] >= a["at"], F.concat(a["out"], piece, F.lit(mask))).otherwise(a["out"])
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), out.alias("out"))

        return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))))

    rows = found_spans(docs, models, into=own)
    hit = F.size(own) > 0
    changed = {"text": F.when(hit, cut(F.col(own))).otherwise(F.col("text"))}
    out = rows.withColumns(changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
