"""Personal data: exact base patterns, and bootstrapped contextual extraction of identifiers that those do not know.

Base spans (email, ip, card, phone) are found by rule and are the seeds. Every other token that looks like an identifier
(five digits or more, or a digit and an @) is a candidate. Seeds and candidates are mentions; a mention's lexical patterns
are the one and two words before it, the word after it, and the words on both sides. Patterns and instances (the values mentioned) form a
graph, which Spark scores in rounds. Known instances are the seeds, scoring 1, the candidates accepted so far (of MIN_SCORE
or more), with their score, and the refused ones, scoring 0: what a base rule looked at and turned down, see refused().
All others are unknown and count neither way. A pattern's confidence is the sum of its known instances' scores over their
number plus one; a candidate's score is the chance that not all of its trusted patterns are wrong, 1 - prod(1 - conf). A
pattern is trusted from MIN_SEEDS distinct seeds or accepted candidates and MIN_CONFIDENCE on, so each round can trust
contexts that only identifiers of the rounds before have. Candidates of MIN_SCORE or more after the last round are found,
and their mentions become spans of kind ``id``, wherever they stand. Refused tokens are scored like other candidates.

Scale: one pass over the texts gives a narrow row a document, with its mentions; the graph has edges for mentions only. Its
rounds are sums grouped by pattern and by instance, pre-aggregated, so a frequent word is no single task's load. Search
of a text is linear in its length. Nothing of the graph reaches the driver.

Null text: empty. Offsets are code points, ends exclusive. Equal rows get equal results. Tables without rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, tidy

ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, MIN_SCORE = 3, 3, 0.6, 0.8
KINDS = ("email", "ip", "card", "phone")
#: Found values of as many bytes at most are broadcast to mask texts; beyond it each text's values are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
SCHEMA = "row bigint, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, mentions array<struct<start:bigint,end:bigint,seed:boolean,refused:boolean,value:string,patterns:array<string>>>"

#: The contract's patterns. An address is looked for from its @, see emails().
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9@._+/-]{3,}[A-Za-z0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_NEAR = 80

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost addresses: what stands before an @ in one run of its characters, and a domain of two labels after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    if not _SIGN.search(text):
        return {k: [] for k in KINDS}
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in spans.items() for a, b in sorted(found))


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a mention from the words beside it."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - _NEAR) : start])][-2:]
    after = [w.lower() for w in _WORD.findall(text[end : end + _NEAR])][:1]
    out = [f"< {before[-1]}"] if before else []
    out += [f"<< {' '.join(before)}"] if len(before) == 2 else []
    out += [f"> {after[0]}"] if after else []
    out += [f"<> {before[-1]} {after[0]}"] if before and after else []
    return out


def candidates(text: str, spans: dict[str, list[Span]]) -> list[Span]:
    """Tokens that look like identifiers and meet no base span."""
    taken = sorted(s for found in spans.values() for s in found)
    out, k = [], 0
    reach = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        digits = len(_DIGIT.findall(m[0]))
        if reach <= a and (digits >= 5 or digits and "@" in m[0]):
            out.append((a, b))
    return out


def refused(token: str) -> bool:
    """Whether a candidate has the form of a card or an ip as a whole and is none: a known non-identifier."""
    if _CARD.fullmatch(token):
        digits = token.replace("-", "")
        return 13 <= len(digits) <= 19 and not luhn(digits)
    return bool(_IP.fullmatch(token)) and not ips(token)


def mentions(text: str, spans: dict[str, list[Span]]) -> list[dict]:
    if not _SIGN.search(text):
        return []
    found = [(a, b, True) for kind in spans for a, b in spans[kind]] + [(a, b, False) for a, b in candidates(text, spans)]
    return [{"start": a, "end": b, "seed": seed, "refused": not seed and refused(text[a:b]), "value": text[a:b].lower(), "patterns": patterns(text, a, b)} for a, b, seed in found]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            spans = base_spans(text)
            out.append((row, None if pd.isna(doc_id) else int(doc_id), *(len(spans[k]) for k in KINDS), joined(spans), mentions(text, spans)))
            row += 1
        columns = ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "mentions"]
        got = pd.DataFrame(out, columns=columns)
        got["doc_id"] = got["doc_id"].astype("Int64")
        yield got


def scan(docs: DataFrame) -> DataFrame:
    """Base counts, base spans and mentions of every row of doc_id, text; written down, with a number for each row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return checkpoint(rows.mapInPandas(tidy(_scan), SCHEMA))


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, min_score: float = MIN_SCORE) -> DataFrame:
    """value, score of the candidates found, from the mentions' graph."""
    said = scanned.where(F.size("mentions") > 0).select(F.explode("mentions").alias("m")).select("m.seed", "m.refused", "m.value", F.explode("m.patterns").alias("pattern"))
    edges = checkpoint(said.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.max("refused").alias("refused")))
    scores = edges.where("not seed").select("value").distinct().withColumn("score", F.lit(0.0))
    for _ in range(rounds):
        score = F.when(F.col("seed"), F.lit(1.0)).when(F.col("refused"), F.lit(0.0)).when(F.col("score") >= min_score, F.col("score"))
        known = edges.join(scores, "value", "left").withColumn("score", score)  # null where unknown
        trusted = (
            known.groupBy("pattern")
            .agg(F.sum("score").alias("_s"), F.count("score").alias("_n"), F.count_if(F.col("score") > 0).alias("_support"))
            .select("pattern", (F.col("_s") / (F.col("_n") + 1)).alias("confidence"), "_support")
            .where((F.col("_support") >= min_seeds) & (F.col("confidence") >= min_confidence))
        )
        unseen = edges.where("not seed").join(trusted, "pattern")
        scores = checkpoint(unseen.groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score")))
    return scores.where(F.col("score") >= min_score)


def find(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans, of every row of doc_id, text."""
    scanned = scan(docs)
    found = bootstrap(scanned).select("value")
    more = scanned.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).where("not m.seed").select("row", "m.start", "m.end", "m.value")
    more = more.join(found, "value", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))
    rows = scanned.drop("mentions").join(more, "row", "left")
    extra = F.transform("found", lambda s: F.concat(F.lit("id:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    base = F.when(F.col("base") != "", F.col("base"))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", base, F.array_join(F.coalesce(extra, F.array().cast("array<string>")), ",")).alias("_spans"), F.size("found").alias("_n"),
    ).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.rtrim("_spans", F.lit(",")).alias("spans"), F.greatest("_n", F.lit(0)).cast("bigint").alias("n_id"))


def mask_text(text: str, found: frozenset[str] | set[str]) -> str:
    """The text with all base spans, and tokens among ``found``, replaced by their kind in brackets."""
    spans = base_spans(text)
    all_ = [(a, b, k) for k in spans for a, b in spans[k]] + [(a, b, "id") for a, b in (candidates(text, spans) if found and _SIGN.search(text) else ()) if text[a:b].lower() in found]
    out, done = [], 0
    for a, b, kind in sorted(all_, key=lambda s: (s[0], -s[1])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, most_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with personal data in their text masked, and n_chars, where there is one, counted anew."""
    found = checkpoint(bootstrap(scan(docs)).select("value"))
    if (found.agg(F.sum(F.octet_length("value"))).first()[0] or 0) <= most_broadcast:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r["value"] for r in found.collect()))
        return docs.mapInArrow(tidy(_masker(docs.columns, known, len(docs.columns))), docs.schema)
    # too many values for every task: each text gets its own
    said = docs.select(F.xxhash64("text").alias("_hash"), F.col("text").cast("string").alias("text")).mapInPandas(_candidate_values, "_hash bigint, value string")
    own = said.join(found, "value", "left_semi").groupBy("_hash").agg(F.collect_set("value").alias("_values"))
    last = "_values"
    while last in docs.columns:
        last += "_"
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64("text").alias("_hash"))  # whole, as its columns may have any names
    with_own = rows.join(own, "_hash", "left").select("_row.*", F.col("_values").alias(last))
    return with_own.mapInArrow(tidy(_masker(docs.columns, None, len(docs.columns))), docs.schema)


def _candidate_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(h, t[a:b].lower()) for h, t in zip(batch["_hash"], batch["text"], strict=True) if t and _SIGN.search(t) for a, b in candidates(t, base_spans(t))]
        yield pd.DataFrame(rows, columns=["_hash", "value"])


def _masker(names: list[str], known: object, width: int) -> object:
    """Masks the text of each row with the values known to all, or with those in the row's last column."""
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [known.value] * batch.num_rows if known is not None else [frozenset(v or ()) for v in batch.column(width).to_pylist()]
            texts = [None if t is None else mask_text(t, v) for t, v in zip(batch.column(at).to_pylist(), values, strict=True)]
            columns = list(batch.columns)[:width]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if count is not None:
                old = batch.column(count)
                columns[count] = pa.array([o if t is None else len(t) for o, t in zip(old.to_pylist(), texts, strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])

    return run
