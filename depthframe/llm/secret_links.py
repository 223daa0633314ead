"""Secrets in texts, with weak parts of one credential linked to each other.

Some spans are reported wherever they stand: assigned secrets, access identifiers of a known form,
long hexadecimal runs. Other parts of a credential are weak: a user name, a random-looking token, a
short password or an address alone says nothing. They are reported only if the parts that complete
them stand near: an identifier with a secret, an address with both. Near means in the same scope (a
paragraph, i.e. a run of lines without a blank line) and with at most ``REACH`` code points between.

The link is an interval join. The parts of a batch of texts are intervals on one line on which
every scope has a place of its own; an interval widened by ``REACH`` meets the intervals of a role
that start before its end, less those that end before its start, so two sorted searches tell every
part whether it has a partner, however many there are. No pairs are formed, nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthframe.llm.common import table
from depthframe.llm.words import slices

REACH = 160
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "secret", "endpoint")
#: Least lengths: value of an assigned secret, access identifier, hexadecimal run.
ASSIGNED, ACCESS, HEX = 6, 20, 24


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def assignment(*names: str) -> re.Pattern:
    """``name = value`` with optional quotes; group 1 is the value."""
    keys = "|".join(map(either_case, names))
    return re.compile(f"(?:{keys})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


ASSIGN = assignment("password", "passwd", "secret", "token", "api_?key")
ACCESS_ID = re.compile("AKIA[A-Z0-9]+")
HEX_RUN = re.compile(f"[0-9a-f]{{{HEX},}}")
NAMED_ID = assignment("user_?name", "user_?id", "user", "login", "account_?name", "account_?id", "account", "client_?id", "key_?id")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20\"'<>`|]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}(?![0-9])")
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n\s*")
#: A text has none of the parts above without one of these.
SIGN = re.compile(r"[:=]|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}")


def looks_random(token: str) -> bool:
    """Digits, capitals and small letters, as in generated keys."""
    return bool(re.search("[0-9]", token) and re.search("[A-Z]", token) and re.search("[a-z]", token))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost non-overlapping matches of every kind; too short ones are left out."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGNED]
    found += [(m.start(), m.end(), "access") for m in ACCESS_ID.finditer(text) if m.end() - m.start() >= ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]
    return found


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Parts that count only in company, none of them overlapping a base span (addresses may)."""
    taken = np.zeros(0, np.int64)
    if base:
        order = sorted((s, e) for s, e, _ in base)
        starts = np.array([s for s, _ in order])
        ends = np.maximum.accumulate([e for _, e in order])
    else:
        starts = ends = taken

    def free(start: int, end: int) -> bool:
        before = np.searchsorted(starts, end)
        return not before or ends[before - 1] <= start

    addresses = [(m.start(), m.end(), "endpoint") for m in ADDRESS.finditer(text)]
    a_starts, a_ends = [a[0] for a in addresses], [a[1] for a in addresses]
    found = [(m.start(), m.end(), "identifier") for m in NAMED_ID.finditer(text)]
    found += [(m.start(), m.end(), "identifier") for m in ACCESS_ID.finditer(text) if 16 <= m.end() - m.start() < ACCESS]
    found += [(m.start(), m.end(), "secret") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) < ASSIGNED]
    named = sorted(found)
    n_starts, n_ends = [x[0] for x in named], [x[1] for x in named]
    for m in LOOSE.finditer(text):
        s, e = m.span()
        i, j = np.searchsorted(n_starts, e), np.searchsorted(a_starts, e)
        inside = (i and n_ends[i - 1] > s) or (j and a_ends[j - 1] > s)
        if not inside and looks_random(m.group()):
            found.append((s, e, "secret"))
    return [x for x in found if free(x[0], x[1])] + addresses


def has_partner(at: np.ndarray, to: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether [at, to) widened by REACH meets one of the intervals; ``starts`` and ``ends`` are sorted apart."""
    return np.searchsorted(starts, to + REACH, "right") > np.searchsorted(ends, at - REACH, "left")


def linked(place: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which parts are reported. ``place`` is where the scope of a part begins on the common line."""
    at, to = place + start, place + end
    kinds = {k: i for i, k in enumerate(KINDS)}
    roles = {
        "identifier": np.isin(kind, [kinds["access"], kinds["identifier"]]),
        "secret": np.isin(kind, [kinds["assign"], kinds["hex"], kinds["secret"]]),
    }
    near = {r: has_partner(at, to, np.sort(at[is_r]), np.sort(to[is_r])) for r, is_r in roles.items()}
    said = kind < len(BASE)
    said |= (kind == kinds["identifier"]) & near["secret"]
    said |= (kind == kinds["secret"]) & near["identifier"]
    return said | ((kind == kinds["endpoint"]) & near["identifier"] & near["secret"])


def batch_spans(texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """Reported (start, kind number, end) of every text, in that order."""
    rows, places, parts, line = [], [], [], 0
    for row, text in enumerate(texts):
        if text and SIGN.search(text):
            base = base_spans(text)
            here = base + weak_spans(text, base)
            if here:
                scopes = np.array([m.end() for m in SCOPE_END.finditer(text)], np.int64)
                scope = np.searchsorted(scopes, [p[0] for p in here], "right")
                rows += [row] * len(here)
                places += [line + int(s) * (2 * REACH + 1) for s in scope]
                parts += [(s, e, KINDS.index(k)) for s, e, k in here]
                line += (len(scopes) + 1) * (2 * REACH + 1) + len(text)
    out: list[list] = [[] for _ in texts]
    if parts:
        start, end, kind = np.array(parts, np.int64).T
        said = linked(np.array(places, np.int64), start, end, kind)
        for i in np.lexsort((end, kind, start, rows)):
            if said[i]:
                out[rows[i]].append((int(start[i]), int(kind[i]), int(end[i])))
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``found``, an array of (kind, start, end) in code points, by start, then kind.

    Null and empty texts have no spans; repeated rows and null ids are answered each; other columns
    are ignored; an empty table gives an empty result. Long texts are read whole.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    shape = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in slices(batches, "text"):
            found = batch_spans(batch["text"].to_pylist())
            flat = [x for spans in found for x in spans]
            offsets = np.concatenate([[0], np.cumsum([len(spans) for spans in found])])
            values = pa.StructArray.from_arrays(
                [
                    pa.array([KINDS[k] for _, k, _ in flat], pa.string()),
                    pa.array([s for s, _, _ in flat], pa.int64()),
                    pa.array([e for _, _, e in flat], pa.int64()),
                ],
                fields=list(shape),
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch["id"], lists], ["id", "found"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(out["id"].alias(id_col), out["found"].alias("found"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def is_kind(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def op13_secret_links(spark, sf_dir: str) -> DataFrame:
    spans = secret_spans(table(spark, sf_dir, "documents"))
    found = F.col("found")
    base = F.filter(found, is_kind(*BASE))
    return spans.select(
        "doc_id",
        *[F.size(F.filter(found, is_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(found).alias("spans"),
    )
