"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain (after Cox, "Regular expression matching with a trigram index").  Postings are kept for the
trigrams that some query names; per document they are intersected by the rules' Boolean
queries, and only candidates are verified with the rule itself.  A rule without mandatory trigrams
scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
import re._constants as sre
import re._parser as sre_parser
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_texts
from .common import pin


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, self.flags).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed patterns.  A maximal run of 24 or more is the same as a run of any length, kept from 24 on.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         re.IGNORECASE | re.ASCII, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("git_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE_RULES + MORE_RULES

#: A literal may stand for so many alternatives before it is given up as "anything".
ALTERNATIVES, CLASS = 64, 8
#: A clause: alternatives, of which one must hold; an alternative: trigrams that must all occur.
Clause = frozenset


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def trigram_query(rule: Rule) -> list[Clause]:
    """Clauses that hold for the lower-cased text of every match; empty: the rule has no mandatory trigram."""
    clauses: set[Clause] = set()

    def close(run: set[str]) -> None:
        options = Clause(trigrams(s) for s in run)
        if all(options):
            clauses.add(options)

    def literals(op, arg) -> set[str] | None:
        """The strings that a node can stand for, when they are few."""
        if op is sre.LITERAL:
            # a letter above ASCII may lower to another length: it ends the run
            return {chr(arg).lower()} if arg < 128 else None
        if op is sre.IN and arg[0][0] is not sre.NEGATE:
            if all(o is sre.LITERAL and a < 128 for o, a in arg) and len(arg) <= CLASS:
                return {chr(a).lower() for _, a in arg}
            return None
        if op is sre.SUBPATTERN:
            return sequence(arg[-1])
        if op is sre.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if op is sre.MAX_REPEAT and arg[1] == 1:
            inner = sequence(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def sequence(nodes) -> set[str] | None:
        run = {""}
        for op, arg in nodes:
            some = literals(op, arg)
            if some is None or len(run) * len(some) > ALTERNATIVES:
                return None
            run = {a + b for a in run for b in some}
        return run

    def walk(nodes) -> None:
        run = {""}
        for op, arg in nodes:
            some = literals(op, arg)
            if some is not None and len(run) * len(some) <= ALTERNATIVES:
                run = {a + b for a in run for b in some}
                continue
            close(run)
            run = {""}
            if some is not None:
                run = some
            elif op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(sre_parser.parse(rule.pattern, rule.flags))
    return sorted(clauses, key=lambda c: sorted(map(sorted, c)))


def postings(docs: DataFrame, grams: list[str], key: str, text: str) -> DataFrame:
    """``key``, ``gram``: the place in ``grams`` of each that occurs in the lower-cased (A-Z) text."""
    kind = docs.schema[key].dataType.simpleString()
    code = [int.from_bytes(g.encode(), "big") for g in grams]
    made: dict[str, np.ndarray] = {}

    def work(rows: dict[str, list]) -> dict[str, list]:
        if "slot" not in made:
            made["slot"] = np.zeros(1 << 24, np.uint16)
            made["slot"][code] = np.arange(1, len(code) + 1)
        out_k, out_g = [], []
        for k, t in zip(rows["k"], rows["text"]):
            b = np.frombuffer((t or "").encode().lower(), np.uint8).astype(np.uint32)
            if len(b) < 3:
                continue
            seen = np.zeros(len(code) + 1, bool)
            seen[made["slot"][(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]] = True
            hits = (np.flatnonzero(seen[1:])).tolist()
            out_k += [k] * len(hits)
            out_g += hits
        return {"k": out_k, "gram": out_g}

    x = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    return map_texts(x, work, f"k {kind}, gram int")


def candidates(index: DataFrame, grams: list[str], queries: list[list[Clause]]) -> DataFrame:
    """``k`` and ``rules``: a bit for each indexed rule whose Boolean query the document's postings satisfy."""
    words = -(-len(grams) // 62)
    masks = index.groupBy("k").agg(*[
        F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in range(words)])
    at = {g: i for i, g in enumerate(grams)}

    def has(option: frozenset[str]) -> Column:
        need = [0] * words
        for g in option:
            need[at[g] // 62] |= 1 << at[g] % 62
        return reduce(and_, [F.col(f"m{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(need) if m])

    bits = F.lit(0)
    for i, q in enumerate(queries):
        if q:
            holds = reduce(and_, [reduce(or_, [has(o) for o in sorted(clause, key=sorted)]) for clause in q])
            bits = bits + F.when(holds, F.lit(1 << i)).otherwise(F.lit(0))
    return masks.select("k", bits.alias("rules")).where("rules != 0")


def _look(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...], hint: str) -> tuple[DataFrame, int]:
    """``docs`` with the column ``hint``: a bit for each rule whose trigrams the row's key was indexed with; and the bits of
    rules that scan every text."""
    queries = [trigram_query(r) for r in rules]
    grams = sorted({g for q in queries for clause in q for option in clause for g in option})
    always = sum(1 << i for i, q in enumerate(queries) if not q)
    if not grams:
        return docs.withColumn(hint, F.lit(0)), always
    index = pin(postings(docs, grams, key, text), "postings")
    hit = candidates(index, grams, queries).select(F.col("k").alias("_at"), F.col("rules").alias(hint))
    x = docs.join(hit, F.col(f"`{key}`").eqNullSafe(F.col("_at")), "left").drop("_at")
    return x.withColumn(hint, F.coalesce(hint, F.lit(0))), always


def spans_of(text: str | None, rules: tuple[Rule, ...], bits: int) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) of the matches of the rules in ``bits``, in order."""
    return sorted((s, i, e) for i, r in enumerate(rules) if text and bits >> i & 1 for s, e in r.spans(text))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: ``key``, the columns ``keep``, and ``_spans`` (kind, start, end).

    Spans are in code points, end exclusive, ordered by start, then by the rules' order.  A null or empty
    text has none.  Rows with equal or null keys are kept apart (the index only says where to look).
    """
    names = {c: f"_d{i}" for i, c in enumerate(dict.fromkeys([key, text, *keep]))}
    x, always = _look(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), names[key], names[text], rules, "_hit")

    def work(cols: dict) -> dict:
        found = [spans_of(t, rules, bits | always) for t, bits in zip(cols["_t"].to_pylist(), cols["_hit"])]
        return cols | {"_spans": [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in f] for f in found]}

    out = {c: names[c] for c in dict.fromkeys([key, *keep])}
    types = {f.name: f.dataType.simpleString() for f in x.schema}
    sent = [a for a in out.values() if a != names[text]]
    same = types[names[text]] == "string"
    if names[text] in out.values() and not same:
        sent.append(names[text])
    y = x.select(*sent, F.col(names[text]).cast("string").alias("_t"), "_hit")
    back = {c: "_t" if a == names[text] and same else a for c, a in out.items()}
    schema = ", ".join([*[f"{a} {types[a] if a != '_t' else 'string'}" for a in back.values()], "_spans array<struct<kind: string, start: int, end: int>>"])
    found = map_texts(y, work, schema, ("_t",), (*sent, "_t"))
    return found.select(*[F.col(a).alias(c) for c, a in back.items()], "_spans")


def span_text(spans: str = "_spans", kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of the given kinds), comma-joined."""
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(kind: str, spans: str = "_spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span found replaced by ``mark`` in its text (overlapping spans become one mark).

    Null texts stay null; all other columns stay as they are.
    """
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    x, always = _look(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), names[key], names[text], rules, "_hit")
    types, t = {f.name: f.dataType.simpleString() for f in x.schema}, names[text]

    def work(cols: dict) -> dict:
        out = []
        for s, bits in zip(cols[t], cols["_hit"]):
            parts, at = [], 0
            for start, _, end in spans_of(s, rules, bits | always):
                if end <= at:
                    continue
                if start >= at:
                    parts += [s[at:start], mark]
                at = end
            out.append(s if not parts else "".join(parts) + s[at:])
        return cols | {t: out}

    schema = ", ".join(f"{a} {types[a]}" for a in names.values())
    fixed = map_texts(x, work, schema, (t,), tuple(a for a in names.values() if a != t))
    return fixed.select(*[F.col(a).alias(c) for c, a in names.items()])
