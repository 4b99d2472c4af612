"""Personal data by bootstrapped contextual extraction.

Seed entities (e-mail and IP addresses, card and phone numbers, and secrets: long hexadecimal keys, by fixed
patterns) induce lexical patterns: the two words before, and the pair of neighbouring words. Tokens that look
like identifiers but are no seeds are candidates and stand in patterns too. Spark scores the graph of patterns
and instances in ``ROUNDS`` rounds: a pattern's confidence in a kind is the share of its distinct instances that
belong to it, smoothed; an unseen instance's score is the noisy-or of its confident patterns. Patterns with
``CONFIDENT`` share and ``SUPPORT`` instances are kept.

A second scan collects whatever token stands in a kept pattern's place, whether it looks like an identifier or not.
The graph of kept patterns and all that stands in them is scored anew, so that a pattern in which ordinary words
stand loses its confidence; what the patterns that stay hold is a span, under the kind they learned.

The first scan's later steps work on the table of spans and candidates, which only documents with digits or an
at sign have. The second scan searches texts for the patterns' words by an automaton, which is broadcast in slices of
at most ``SLICE_BYTES``, one scan each. Counting is partial aggregation, so a pattern or instance that is
everywhere is one row a task.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; spans of
one kind never overlap, and none that is no base span overlaps one; equal texts have equal spans; repeated rows
and null keys are each reported; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lean, maybe_broadcast, plus, table, tuned, union_all, written

#: Fixed values, in the order in which results list them.
KINDS = ("email", "ip", "card", "phone")
#: Kinds of the method's own seeds, listed after those.
MORE = ("secret",)

ROUNDS = 3
CONFIDENT = 0.75
SUPPORT = 4
LEAST_DIGITS = 4
SLICE_BYTES = 8 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried from its first digit only: later ones cannot match where that one fails.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
_SOME = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()|*#%$&[]{}<>"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs, in linear time."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += (x * 2 - 9 if x > 4 else x * 2) if i % 2 else x
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    if not text or _SOME.search(text) is None:
        return []
    out = [("email", a, z) for a, z in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def seeds(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and secrets that overlap none of them."""
    base = base_spans(text)
    if not text or _SOME.search(text) is None:
        return base, []
    taken = _Taken(base)
    return base, [("secret", m.start(), m.end()) for m in _SECRET.finditer(text) if not m[0].isdigit() and not m[0].isalpha() and not taken(m.start(), m.end())]


class _Taken:
    """Whether a range overlaps one of some spans."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = sorted((a, z, k) for k, a, z in spans)
        self.ends = []
        for _, z, _ in self.spans:
            self.ends.append(max(z, self.ends[-1]) if self.ends else z)

    def __call__(self, a: int, z: int) -> tuple[int, int, str] | None:
        i = bisect_left(self.spans, (z, 0, "")) - 1
        while i >= 0 and self.ends[i] > a:
            if self.spans[i][1] > a:
                return self.spans[i]
            i -= 1
        return None


def _folded(text: str) -> str:
    """Lower case with every digit a 0, at the same positions."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_ZERO)


_ZERO = str.maketrans("123456789", "000000000")


def _core(text: str, a: int, z: int) -> tuple[int, int]:
    """A token's range without the signs at its edges."""
    while a < z and text[a] in _EDGE:
        a += 1
    while a < z and text[z - 1] in _EDGE:
        z -= 1
    return a, z


def _patterns(words: tuple[str, str, str]) -> list[str]:
    """Of a place: the word before the one before, the one before, and the one after it."""
    far, left, right = words
    return [f"L {far} {left}"] * bool(far and left) + [f"B {left} {right}"] * bool(left and right)


def instances(text: str | None, found: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, list[str]]]:
    """Seeds (found) and candidates with their patterns: (kind or None, start, end, normalised text, patterns)."""
    if not text or _SOME.search(text) is None:
        return []
    low = _folded(text)
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in tokens]

    def word(k: int) -> str:
        a, z = _core(low, *tokens[k]) if 0 <= k < len(tokens) else (0, 0)
        return low[a:z]

    def patterns(a: int, z: int) -> list[str]:
        i = bisect_left(starts, a + 1) - 1
        return _patterns((word(i - 2), word(i - 1), word(bisect_left(starts, z))))

    taken = _Taken(found)
    out = [(k, a, z, text[a:z].lower(), patterns(a, z)) for k, a, z in found]
    for a, z in tokens:
        a, z = _core(text, a, z)
        core = text[a:z]
        if not core or (sum("0" <= c <= "9" for c in core) < LEAST_DIGITS and "@" not in core) or taken(a, z):
            continue
        out.append((None, a, z, core.lower(), patterns(a, z)))
    return out


class Places:
    """Finds the places of patterns in texts, by their word to the left."""

    def __init__(self, patterns: list[str]):
        self.patterns = frozenset(patterns)
        self.words = ahocorasick.Automaton()
        for w in {x.split(" ")[2 if x[0] == "L" else 1] for x in patterns}:
            self.words.add_word(w, w)
        if patterns:
            self.words.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[str | None, int, int, str, list[str]]]:
        """Like instances(), of what stands in the patterns' places."""
        if not text or not self.patterns:
            return []
        low = _folded(text)
        out, taken, done = [], None, -1
        for last, w in self.words.iter(low):
            a, z = last + 1 - len(w), last + 1
            if a <= done or (a and not low[a - 1].isspace() and low[a - 1] not in _EDGE) or (z < len(low) and not low[z].isspace() and low[z] not in _EDGE):
                continue
            m = _AFTER.match(low, z)
            if not m:
                continue
            begin = a
            while begin and not low[begin - 1].isspace():
                begin -= 1
            if _core(low, begin, m.start(1)) != (a, z):  # a longer token than the word
                continue
            done = a
            end = begin
            while end and low[end - 1].isspace():
                end -= 1
            far = end
            while far and not low[far - 1].isspace():
                far -= 1
            if taken is None:
                taken = _Taken([x for part in seeds(text) for x in part])
            b, e = _core(text, m.start(2), m.end(2))
            seed = taken(b, e) if b < e else None
            if seed:
                b, e = seed[0], seed[1]
            right = _AFTER.match(low, e)
            x, y = _core(low, far, end)
            r, s = _core(low, right.start(2), right.end(2)) if right else (0, 0)
            found = [p for p in _patterns((low[x:y], w, low[r:s])) if p in self.patterns]
            if found and b < e:
                out.append((seed[2] if seed else None, b, e, text[b:e].lower(), found))
        return out


#: The rest of a token, blanks, and the next token.
_AFTER = re.compile(r"\S*()\s+(\S+)")

_FOUND = "array<struct<kind:string,start:long,end:long,value:string,patterns:array<string>>>"
_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _rows(found) -> list[dict]:
    return [{"kind": k, "start": a, "end": z, "value": v, "patterns": p} for k, a, z, v, p in found]


def _mark(text: str) -> Column:
    """A text's 128-bit hash: spans depend on the text alone."""
    return F.md5(F.col(text).cast("binary"))


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark, spans of the fixed patterns, and found: seeds and candidates with patterns."""
    tuned(docs.sparkSession)
    rows = docs.select(F.col(text).alias("_text"), F.col(key), _mark(text).alias("mark"))
    schema = plus(rows.drop("_text").schema, f"spans {_SPANS}, found {_FOUND}")

    def run(batches):
        for b in batches:
            spans, founds = [], []
            for t in b.column(0):
                t = t.as_py()
                base, more = seeds(t)
                spans.append([{"kind": k, "start": a, "end": z, "base": own} for part, own in ((base, True), (more, False)) for k, a, z in part])
                founds.append(_rows(instances(t, base + more)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(spans, _SPANS_TYPE), pa.array(founds, _FOUND_TYPE)], names=schema.names)

    return rows.mapInArrow(lean(run), schema)


def _placed(docs: DataFrame, text: str, good: DataFrame, rows: int) -> DataFrame:
    """mark, found: of each text what stands in the places of the patterns; one scan for each slice of them."""
    n = max(1, -(-rows * 64 // SLICE_BYTES))

    def scan(k: int) -> DataFrame:
        own = good.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k) if n > 1 else good
        held = docs.sparkSession.sparkContext.broadcast([r["pattern"] for r in own.select("pattern").collect()])

        def run(batches):
            places = Places(held.value)
            for b in batches:
                at, founds = [], []
                for i, t in enumerate(b.column(0)):
                    if found := places(t.as_py()):
                        at.append(i)
                        founds.append(_rows(found))
                if at:
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.array(founds, _FOUND_TYPE)], names=["mark", "found"])

        return docs.select(F.col(text).alias("_text"), _mark(text).alias("mark")).mapInArrow(lean(run), f"mark string, found {_FOUND}")

    return written(union_all([scan(k) for k in range(n)]).dropDuplicates(["mark"] if n == 1 else ["mark", "found"]), "pii-places")


def learn(found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """pattern, kind, confidence of the patterns that extract. found: rows of _scan()."""
    each = found.select(F.explode("found").alias("x")).select(F.col("x.kind").alias("seed"), F.xxhash64("x.value").alias("instance"), F.explode("x.patterns").alias("pattern"))
    edges = written(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = edges.where("seed is not null").groupBy("instance").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
    scores, good = seeds, None
    for _ in range(rounds):
        held = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= 0.5).alias("n"))
        rated = held.join(totals, "pattern").withColumn("confidence", F.col("mass") / (F.col("total") + 0.5))
        best = rated.groupBy("pattern").agg(F.max(F.struct("confidence", "kind", "n")).alias("b")).select("pattern", "b.*")
        good = written(best.where((F.col("confidence") >= confident) & (F.col("n") >= support)).select("pattern", "kind", "confidence"), "pii-patterns")
        unseen = edges.where("seed is null").join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        unseen = unseen.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score").join(seeds.select("instance"), "instance", "left_anti")
        scores = written(seeds.unionByName(unseen), "pii-scores")
    return good


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """key, mark (hash of the text), spans array<struct<kind, start, end, base>>: by kind as listed, then start."""
    found = written(_scan(docs, key, text), "pii-found")
    kept = learn(found, confident=confident)
    n = kept.count()
    if not n:
        return found.select(key, "mark", "spans")
    placed = _placed(docs, text, kept, n)
    good = learn(placed, confident=confident)
    patterns = maybe_broadcast(good, good.count(), 128)
    mine = placed.select("mark", F.explode("found").alias("x")).where("x.kind is null")
    mine = mine.select("mark", "x.start", "x.end", F.explode("x.patterns").alias("pattern")).distinct().join(patterns, "pattern")
    mine = mine.groupBy("mark", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    more = mine.groupBy("mark").agg(F.collect_set(F.struct(F.col("b.kind").alias("kind"), "start", "end", F.lit(False).alias("base"))).alias("more"))
    order = F.array(*[F.lit(k) for k in KINDS + MORE])
    rank = lambda s: F.struct(F.array_position(order, s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.transform(F.array_sort(F.transform(F.concat("spans", "more"), rank)), plain))
    small = maybe_broadcast(more, more.count(), 512)
    return found.select(key, "mark", "spans").join(small, "mark", "left").select(key, "mark", spans.alias("spans"))


def mask(docs: DataFrame, found: DataFrame, text: str = "text", sign: str = "[{}]") -> DataFrame:
    """docs with every span of found (from find()) in the text replaced by its kind; overlaps are one span."""
    tuned(docs.sparkSession)
    mark, spans_at = fresh(docs, "_mark"), fresh(docs, "_spans")
    marked = written(found.where(F.size("spans") > 0).select(F.col("mark").alias(mark), F.col("spans").alias(spans_at)).dropDuplicates([mark]), "pii-marked")
    small = maybe_broadcast(marked.select(mark), marked.count(), 48)
    rows = docs.withColumn(mark, _mark(text))
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column(at), b.column(b.num_columns - 1).to_pylist(), strict=True):
                t = t.as_py()
                parts, end = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= end:
                        parts += [t[end : s["start"]], sign.format(s["kind"])]
                    end = max(end, s["end"])
                texts.append("".join([*parts, t[end:]]))
            columns = b.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    clean = rows.join(small, mark, "left_anti").drop(mark)
    hit = rows.join(small, mark, "left_semi").join(marked, mark).select(*docs.columns, spans_at)
    return clean.unionByName(hit.mapInArrow(lean(run), schema))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    written_as = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(written_as(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), written_as(F.col("spans")).alias("spans"))
