"""Lexicon scan of a post's channels: scores and guards with spans in the original text.

The lexicon is a table of (root, variant, route): a word hits if it is a variant, perhaps with Turkish endings. Rules around a
candidate, each a field of ``Lexicon``: it has letters, digits at its edges are cut off, what follows an apostrophe is an ending; listed clean words and words of
clean stems never hit, save where the endings break vowel harmony; a variant with ``forms`` takes only these endings; single letters parted by single spaces hit
as one word if the whole run spells one, and never in part; a compound (a variant of several words) hits on consecutive words, only the last with
endings; a masked word hits if exactly one variant fits its letters. A variant inside another word is no hit but a collision, which guards the
word. A hit near a cue of another meaning gets a homonym guard. Hits nested in a longer one are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.functions import target

#: Content code of each route and the evidence strengths.
ROUTES = {"A": "A1", "B1": "B1", "B2": "B2", "B3": "B3"}
HIT, MASKED, GUARD = 0.9, 0.6, 0.9


def lower(text: str) -> str:
    """Turkish lower case."""
    return text.translate({ord("I"): "ı", ord("İ"): "i"}).lower()


_ENDINGS = re.compile(f"(?:{'|'.join(target.ENDS)})*")


def _endings(tail: str) -> bool:
    return _ENDINGS.fullmatch(tail) is not None


KNOWN = 50_000


@dataclass(frozen=True)
class Lexicon:
    variants: dict[str, tuple[str, str]]  # variant to (root, route)
    clean: frozenset[str] = frozenset()
    homonyms: dict[str, str] = field(default_factory=dict)  # root to a pattern of its other meaning
    clean_stems: frozenset[str] = frozenset()
    forms: dict[str, frozenset[str]] = field(default_factory=dict)  # variant to the endings that it takes, if not all

    @cached_property
    def lengths(self) -> tuple[int, ...]:
        return tuple(sorted({len(v) for v in self.variants if len(v) >= 3}))

    @cached_property
    def compounds(self) -> dict[str, list[tuple[str, ...]]]:
        """By first word."""
        out: dict[str, list[tuple[str, ...]]] = {}
        for v in self.variants:
            if len(parts := tuple(v.split())) > 1:
                out.setdefault(parts[0], []).append(parts)
        return out

    @cached_property
    def by_length(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for v in self.variants:
            out.setdefault(len(v), []).append(v)
        return out

    @cached_property
    def quiet(self) -> set[str]:
        """Short pieces of text that neither hit nor collide, emptied when there are too many."""
        return set()

    @cached_property
    def judged_words(self) -> dict[str, tuple]:
        """What is known of words, emptied when it is full."""
        return {}


def lexicon_of(rows: list[tuple[str, str, str]], clean: list[str] = (), homonyms: dict[str, str] | None = None, clean_stems: list[str] = (), forms: dict[str, list[str]] | None = None) -> Lexicon:
    words = lambda xs: frozenset(map(lower, xs))
    return Lexicon({lower(v): (r, k) for r, v, k in rows if k in ROUTES}, words(clean), homonyms or {}, words(clean_stems), {lower(v): words(e) for v, e in (forms or {}).items()})


def harmonic(stem: str, tail: str) -> bool:
    """Do the vowels of the endings go with the stem's last one?"""
    last = re.search(f"[{VOWELS}](?=[^{VOWELS}]*$)", stem)
    return last is None or not set(tail) & set(VOWELS) - set(target.VOWELS_BEHIND[last[0]])


VOWELS = "".join(target.VOWELS_BEHIND)


def ends_well(word: str, variant: str, lex: Lexicon) -> bool:
    tail = word[len(variant) :]
    return tail in lex.forms[variant] or not tail if variant in lex.forms else _endings(tail)


def root_of(word: str, lex: Lexicon) -> str | None:
    """The longest variant that the word is, perhaps with endings."""
    if word in lex.clean or any(word[:n] in lex.clean_stems and _endings(word[n:]) and harmonic(word[:n], word[n:]) for n in range(len(word), 1, -1)):
        return None
    return next((word[:n] for n in range(len(word), 1, -1) if word[:n] in lex.variants and ends_well(word, word[:n], lex)), None)


def inside(word: str, lex: Lexicon) -> list[tuple[int, str]]:
    """(place, variant) of the first place of every variant in a word, by pieces of the variants' lengths."""
    found: dict[str, int] = {}
    for n in lex.lengths:
        for i in range(len(word) - n + 1):
            if word[i : i + n] in lex.variants:
                found.setdefault(word[i : i + n], i)
    return [(i, v) for v, i in found.items()]


def looked_up(word: str, lex: Lexicon) -> tuple[str | None, list[tuple[int, str]]]:
    """(variant that hits, or else the collisions) of a word, remembered."""
    known = lex.judged_words
    if word not in known:
        if len(known) >= KNOWN:
            known.clear()
        variant = root_of(word, lex)
        known[word] = variant, [] if variant is not None or word in lex.clean else inside(word, lex)
    return known[word]


WORD = re.compile(r"[^\W_]+(?:[*#]+[^\W_]+)*(?:['’][^\W_]+)?")
SPELLED = re.compile(r"(?<![^\W_])(?<![^\W_] )[^\W\d_](?: [^\W\d_]){2,}(?![^\W_])(?! [^\W\d_](?![^\W_]))")

SINGLE = re.compile(r" [^\W\d_] ")
#: Up to so many variants a text is first searched for as they are: without one of them, no word of it can hit.
FEW = 64


def scan(text: str, lex: Lexicon) -> tuple[list[tuple], list[tuple]]:
    """(hits, collisions): (start, end, variant, sure) and (start, end, variant)."""
    hits, collisions = [], []
    words: list[tuple[int, str]] = []
    for m in SPELLED.finditer(text) if SINGLE.search(text) else ():
        if (v := root_of(m[0].replace(" ", ""), lex)) is not None:
            hits.append((*m.span(), v, HIT))
    if not lex.compounds and len(lex.variants) <= FEW and "*" not in text and "#" not in text and not any(v in text for v in lex.variants):
        return _outermost(hits), []
    quiet = lex.quiet
    for m in WORD.finditer(text):
        if m[0] in quiet and not lex.compounds:
            continue
        word = re.split("['’]", m[0])[0]
        a = m.start() + len(word) - len(word.lstrip("0123456789"))
        word = word.strip("0123456789")
        if not any(c.isalpha() for c in word):
            continue
        words.append((a, word))
        if "*" in word or "#" in word:
            shape = re.compile("".join(f"[^\\W\\d_]{{{len(p)}}}" if p[0] in "*#" else re.escape(p) for p in re.findall(r"[*#]+|[^*#]+", word)))
            fit = [v for v in lex.by_length.get(len(word), ()) if shape.fullmatch(v)]
            if len(fit) == 1:
                hits.append((a, a + len(word), fit[0], MASKED))
            continue
        v, within = looked_up(word, lex)
        if v is not None:
            hits.append((a, a + len(word), v, HIT))
        collisions += [(a + i, a + i + len(x), x) for i, x in within]
        if v is None and not within and len(m[0]) <= 40:
            if len(quiet) >= KNOWN:
                quiet.clear()
            quiet.add(m[0])
    for k, (a, word) in enumerate(words if lex.compounds else ()):
        for parts in lex.compounds.get(word, ()):
            row = words[k : k + len(parts)]
            apart = [text[x + len(w) : y].isspace() for (x, w), (y, _) in zip(row, row[1:], strict=False)]
            last = row[-1][1]
            if len(row) == len(parts) and all(apart) and [w for _, w in row[:-1]] == list(parts[:-1]) and last.startswith(parts[-1]) and _endings(last[len(parts[-1]) :]):
                hits.append((a, row[-1][0] + len(last), " ".join(parts), HIT))
    hits = _outermost(hits)
    return hits, [c for c in collisions if not any(h[0] <= c[0] and c[1] <= h[1] for h in hits)]


def _outermost(hits: list[tuple]) -> list[tuple]:
    return [h for h in dict.fromkeys(hits) if not any(o[:2] != h[:2] and o[0] <= h[0] and h[1] <= o[1] for o in hits)]


def judged(channels: dict[str, tuple[str, list[int]]], lex: Lexicon, non_human: bool = False) -> tuple[list[dict], list[dict]]:
    """(content, guards) of the channels (text, offsets into the original)."""
    content, guards = [], []
    for channel, (text, offsets) in channels.items():
        source = f"m1_lexicon@{channel}"
        place = lambda a, z, o=offsets: {"start": o[a], "end": o[z - 1] + 1}
        guard = lambda code, span, why, s=source: guards.append({"code": code, "score": GUARD, "source": s, "evidence": why, "span": span, "threshold": None, "active": None, "suppressed": []})
        hits, collisions = scan(text, lex)
        for a, z, v, sure in hits:
            root, route = lex.variants[v]
            content.append({"code": ROUTES[route], "score": sure, "source": source, "span": place(a, z), "threshold": None, "fired": None})
            if (cue := lex.homonyms.get(root)) and re.search(cue, text[max(0, a - 12) : z + 12]):
                guard("HOMONYM", place(a, z), root)
            if non_human:
                guard("NON_HUMAN_TARGET", place(a, z), root)
        for a, z, v in collisions:
            guard("SUBSTRING_COLLISION", place(a, z), v)
    return content, guards


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_CONTENT = pa.list_(pa.struct([("code", pa.string()), ("score", pa.float64()), ("source", pa.string()), ("span", _SPAN), ("threshold", pa.float64()), ("fired", pa.bool_())]))
_GUARDS = pa.list_(pa.struct([("code", pa.string()), ("score", pa.float64()), ("source", pa.string()), ("evidence", pa.string()), ("span", _SPAN), ("threshold", pa.float64()), ("active", pa.bool_()), ("suppressed", pa.list_(pa.string()))]))


def analysed(rows: DataFrame, lex: Lexicon, key: str = "id", words: frozenset[str] | None = None, groups: frozenset[str] = frozenset(), things: frozenset[str] = frozenset(), second_channel: bool = True) -> DataFrame:
    """All modules on (key, text): content, guards, target, form and what failed. Personal data, and targets in texts with rare characters, come from Spark itself; the other
    modules run in order on one pass over the row; one that fails leaves its part empty and is named in ``failed``, and the row goes on."""
    from moderix.functions import charsafe, deobfuscate
    from moderix.operators.decision import GUARD as GUARD_T
    from moderix.operators.decision import SCORE

    kind = rows.select(key).schema[0].dataType.simpleString()

    small = frozenset(map(lower, groups)), frozenset(map(lower, things))

    def one(text: str | None, who: dict | None, dox: list[dict]) -> tuple:
        text, failed = text or "", []
        if target.RARE.search(text) is None:
            who = target.first_target(text, *small)

        def tried(name: str, f, otherwise):  # noqa: ANN001, ANN202
            try:
                return f()
            except Exception:  # noqa: BLE001
                failed.append(name)
                return otherwise

        same = list(range(len(text)))
        c = tried("m0_charsafe", lambda: charsafe.cleaned(text), charsafe.Clean(list(text), same, same))
        n, offsets, repairs = tried("m2_deobf", lambda: deobfuscate.repaired(c.text, text, c.start, words), (c.text, c.start, []))
        channels = {"raw": (c.text, c.start)} | ({"normalized": (n, offsets)} if second_channel and n != c.text else {})
        content, guards = tried("m1_lexicon", lambda: judged(channels, lex, who is not None and who["type"] == "non_human"), ([], []))
        content = content + [{"code": "B4", "score": d["confidence"], "source": "m6_target@raw", "span": {"start": d["start"], "end": d["end"]}, "threshold": None, "fired": None} for d in dox]
        first = who or {"type": None, "confidence": None}
        return content, guards, first["type"], first["confidence"], [*c.patterns, *repairs], list(dict.fromkeys(failed))

    types = (_CONTENT, _GUARDS, pa.string(), pa.float64(), charsafe._ARROW, pa.list_(pa.string()))
    names = [key, "content", "guards", "target_type", "target_confidence", "form", "failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(*x) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[i] for g in got], t) for i, t in enumerate(types))], names)

    t = F.col("text").cast("string")
    # Spark looks for targets only in texts with rare characters, whose words Python may see otherwise, and for identifiers where there may be some
    some = lambda has: F.when(t.rlike(has), t).otherwise("")
    seen = rows.select(F.col(f"`{key}`"), t.alias("text"), some(target.RARE.pattern).alias("_rare"), some(target.MAYBE).alias("_maybe"))
    seen = seen.select(F.col(f"`{key}`"), "text", F.get(target.targets(F.col("_rare"), groups, things, 1), 0).alias("who"), target.identifiers(F.col("_maybe")).alias("dox"))
    return seen.mapInArrow(run, f"`{key}` {kind}, content array<{SCORE}>, guards array<{GUARD_T}>, target_type string, target_confidence double, form {charsafe.PATTERN}, failed array<string>")
