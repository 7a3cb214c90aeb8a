"""License scan by ordered signature rules, in Spark's own functions only.

A rule is a label, a keyword, a pattern over words, a priority and a weight. A text is brought to
words of a-z, 0-9 and letters beyond ASCII, joined by single spaces. Only texts that hold a general
hint are looked at, and in them only rules of which fixed parts are there (`holds`); every match of a rule
implies both. The work on a text grows with its length, however many places it has.
Rules name licenses (FAMILIES in the forms of grants and tags) or know texts, notices and addresses
(`license_texts`). Expressions in tags and grants of several licenses are taken apart into their parts; a
plus sign behind an identifier is lost with the words' borders. Where the place of one detection lies
inside that of another of the same or higher priority, it is suppressed; what is left gives the labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewarden.llm.license_texts import CC_KINDS, CC_VERSIONS, GRANTS as _GRANTS, signatures, tags

_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: What a named license's match holds: one of these, or a verb of a grant without 'licen' with 'under' behind it.
_HINTS = ("licen", "spdx", "public domain")
#: Fixed base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families: label, keyword of all names, names as written in prose (words only), identifiers (words only).
FAMILIES = [
    ("mit", "mit", "mit", "mit"),
    ("mit", "expat", "expat", "mit"),
    ("mit-0", "mit", "mit no attribution|mit 0", "mit 0"),
    ("apache-1.1", "apache", "apache (?:software )?(?:license )?(?:version )?1 1", "apache 1 1"),
    ("apache-2", "apache", "apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?", "apache 2 0"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd 4 clause"),
    ("0bsd", "bsd", "zero clause bsd|0bsd", "0bsd"),
    ("gpl-1", "gpl", "gnu gpl (?:version |v)?1|gpl ?v?1(?: 0)?", "gpl 1 0"),
    ("gpl-2", "gpl", "gnu gpl (?:version |v)?2|gpl ?v?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", "gpl", "gnu gpl (?:version |v)?3|gpl ?v?3(?: 0)?", "gpl 3 0"),
    ("gpl-1", "gnu", "gnu general public license (?:version |v)?1(?: 0)?", "gnu gpl 1"),
    ("gpl-2", "gnu", "gnu general public license (?:version |v)?2(?: 0)?", "gnu gpl 2"),
    ("gpl-3", "gnu", "gnu general public license (?:version |v)?3(?: 0)?", "gnu gpl 3"),
    ("gpl", "gnu", "gnu general public license|gnu gpl", "gnu gpl"),
    ("lgpl-2.0", "lgpl", "lgpl ?v?2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?2 1", "lgpl 2 1"),
    ("lgpl-3", "lgpl", "lgpl ?v?3(?: 0)?", "lgpl 3 0"),
    ("lgpl-2.1", "gnu", "gnu lesser general public license (?:version |v)?2 1", "gnu lgpl 2 1"),
    ("lgpl-3", "gnu", "gnu lesser general public license (?:version |v)?3(?: 0)?", "gnu lgpl 3"),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public license", "gnu lgpl"),
    ("agpl-3", "agpl", "agpl ?v?3(?: 0)?", "agpl 3 0"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?: (?:version |v)?3(?: 0)?)?", "gnu agpl 3"),
    ("gfdl-1.2", "gnu", "gnu free documentation license (?:version |v)?1 2", "gfdl 1 2"),
    ("gfdl-1.3", "gnu", "gnu free documentation license (?:version |v)?1 3", "gfdl 1 3"),
    ("mpl-1.1", "mozilla", "mozilla public license (?:version |v)?1 1", "mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public license (?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("mpl-2", "mpl", "mpl (?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("epl-1", "eclipse", "eclipse public license (?:version |v)?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public license (?:version |v)?2(?: 0)?", "epl 2 0"),
    ("cddl-1", "cddl", "cddl (?:version |v)?1(?: 0)?", "cddl 1 0"),
    ("cddl-1.1", "cddl", "cddl (?:version |v)?1 1", "cddl 1 1"),
    ("cpl-1", "common", "common public license(?: (?:version |v)?1 0)?", "cpl 1 0"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng", "libpng|libpng 2 0"),
    ("boost-1", "boost", "boost software(?: license)?(?: (?:version )?1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", "the unlicense|unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("artistic-1", "artistic", "artistic (?:license )?(?:version )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic (?:license )?(?:version )?2(?: 0)?", "artistic 2 0"),
    ("afl-3", "academic", "academic free license(?: (?:version |v)?3(?: 0)?)?", "afl 3 0"),
    ("osl-3", "open", "open software license(?: (?:version |v)?3(?: 0)?)?", "osl 3 0"),
    ("eupl-1.2", "eupl", "eupl(?: (?:version |v)?1 2)?", "eupl 1 2"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: (?:version )?1 1)?", "ofl 1 1"),
    ("psf-2", "python", "python software foundation license(?: (?:version )?2)?", "psf 2 0"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("php-3", "php", "php (?:license )?(?:version )?3(?: 01)?", "php 3 01"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("odbl-1", "database", "open database license(?: (?:version |v)?1 0)?", "odbl 1 0"),
    ("odc-by-1", "attribution", "open data commons attribution license", "odc by 1 0"),
    ("cc0-1", "cc0", "cc0(?: 1 0)?", "cc0 1 0"),
    ("public-domain", "domain", "public domain", "public domain"),
    ("proprietary", "proprietary", "proprietary", "licenseref proprietary"),
    *[(f"cc-{kind.replace(' ', '-')}", "cc", f"cc {kind}", f"cc {kind}") for kind in CC_KINDS],
    *[
        (f"cc-{kind.replace(' ', '-')}-{number}", "cc", f"cc {kind} (?:{words}|{number})" if words.endswith(" 0") else f"cc {kind} {words}", f"cc {kind} {words}")
        for kind in CC_KINDS
        for words, number in CC_VERSIONS.items()
    ],
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """Every family in the forms in which texts grant, name or tag a license; higher priority first."""
    out = []
    for label, keyword, names, tag in FAMILIES:
        out += [
            Rule(label, re.match("[a-z0-9]+", tag)[0], f"spdx license identifier (?:{tag})", 4, 1.0),
            Rule(label, keyword, f"(?:{_GRANTS}) under (?:the )?(?:terms of )?(?:the )?(?:{names})(?: license)?", 3, 0.95),
            Rule(label, keyword, f"(?:under|by|with) the (?:terms of the )?(?:{names})(?: license)", 2, 0.85),
            Rule(label, keyword, f"(?:{names}) licen[sc]ed?", 1, 0.7),
            Rule(label, keyword, f"license (?:is )?(?:{names})(?: license)?", 1, 0.6),
        ]
    return sorted(dict.fromkeys(out), key=lambda r: (-r.priority, r.label, r.pattern))


def text_rules() -> list[Rule]:
    """License texts, notices, full names and addresses; higher priority first."""
    return sorted((Rule(*x) for x in signatures()), key=lambda r: (-r.priority, r.label, r.pattern))


def identifiers() -> dict[str, str]:
    """Every identifier that a tag may hold, as words, and its label."""
    return {t: label for label, _, _, tag in FAMILIES for t in tag.split("|")} | tags()


def _any_of(patterns) -> str:
    return "|".join(sorted(dict.fromkeys(patterns), key=lambda x: (-len(x), x)))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fixed(pattern: str) -> str:
    """A pattern without top-level alternatives, its groups as '#': what every match holds, but for letters before a question mark."""
    plain, depth = "", 0
    for c in pattern:
        depth += c == "("
        plain += "#" if depth else c
        depth -= c == ")"
    return plain


def _closing(pattern: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(pattern)):
        depth += (pattern[i] == "(") - (pattern[i] == ")")
        if not depth:
            return i
    raise ValueError(pattern)


def _alternatives(pattern: str) -> list[str]:
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def holds(pattern: str) -> set[frozenset[str]]:
    """Sets of literal parts: every match of the pattern holds all parts of at least one set.

    For the patterns of this module: literals, character classes, groups, `?` and counts in braces.
    """
    out = set()
    for rest in _alternatives(pattern):
        runs, sets, i = [""], {frozenset()}, 0
        while i < len(rest):
            c = rest[i]
            if c not in "([":
                optional = rest[i + 1 : i + 2] == "?"
                runs += [""] if optional else []
                runs[-1] += "" if optional else c
                i += 1 + optional
                continue
            end = _closing(rest, i) if c == "(" else rest.index("]", i)
            inner, group = rest[i + 3 : end], rest[i : i + 3] == "(?:"
            count = re.match(r"(?:\?|\{\d+,\d+\}\??)?", rest[end + 1 :])[0]
            if group and not count and len(_alternatives(inner)) == 1:
                rest = rest[:i] + inner + rest[end + 1 :]
                continue
            if group and not count:
                sets = {x | y for x in sets for y in holds(inner)}
            runs.append("")
            i = end + 1 + len(count)
        fixed = frozenset(r for r in runs if r.strip())
        out |= {x | fixed for x in sets}
    return out


def _needed(rule: Rule) -> list[list[str]]:
    """`holds` of a rule between words: its keyword and the two longest parts of each set."""
    sets = {(rule.keyword, *sorted(x, key=lambda w: (-len(w), w))[:2]) for x in holds(f" (?:{rule.pattern}) ")}
    return sorted(map(list, sets))


def _hint(low: str) -> str:
    """SQL: whether a lower-cased text may hold a phrase or a match of any rule."""
    grant = _literal(f"(?:{_GRANTS}){_GAP}+under")
    # A signature that need not hold 'licen' opens the gate by its keyword and two more of the words that it must hold.
    own: dict[str, set[str]] = {}
    for r in text_rules():
        fixed = _fixed(r.pattern)
        if "licen" not in fixed:
            words = {w for w in fixed.split(" ") if re.fullmatch("[a-z][a-z0-9]+", w)} - {r.keyword}
            more = [f"contains({low}, '{w}')" for w in sorted(words, key=lambda w: (-len(w), w))[:2]]
            own.setdefault(r.keyword, set()).add(" AND ".join(more) or "true")
    signs = "".join(f" OR contains({low}, '{k}') AND ({' OR '.join(sorted(x))})" for k, x in sorted(own.items()))
    return " OR ".join(f"contains({low}, '{h}')" for h in _HINTS) + f"{signs} OR contains({low}, 'cc') AND contains({low}, 'nc') OR contains({low}, 'under') AND {low} RLIKE {grant}"


#: Entries of an array that are gone through in one go: appending copies what is there, so long arrays go in blocks.
_BLOCK = 256


def _blocks(array: str) -> str:
    """SQL: an array that is not empty, cut into blocks."""
    return f"transform(sequence(0, (size({array}) - 1) div {_BLOCK}), b -> slice({array}, b * {_BLOCK} + 1, {_BLOCK}))"


def _so_far(values: str, zero: str, merge: str, kind: str) -> str:
    """SQL: for each entry, the merge (of t.now and x) of all entries before it."""
    return f"aggregate({values}, named_struct('now', {zero}, 'list', cast(array() AS array<{kind}>)), (t, x) -> named_struct('now', {merge}, 'list', concat(t.list, array(t.now))), t -> t.list)"


def _places(text: str, pattern: str) -> str:
    """SQL for array<struct<start,stop>>, code points, of a pattern's matches."""
    none = "cast(array() AS array<struct<start:int,stop:int>>)"
    steps = f"zip_with(cut, regexp_extract_all({text}, {pattern}, 0), (p, m) -> named_struct('gap', length(p), 'size', length(m)))"
    block = (
        f"aggregate(block, named_struct('at', 0, 'spans', {none}), (s, x) -> named_struct('at', s.at + x.gap + coalesce(x.size, 0), 'spans', "
        "CASE WHEN x.size IS NULL THEN s.spans ELSE concat(s.spans, array(named_struct('start', s.at + x.gap, 'stop', s.at + x.gap + x.size))) END))"
    )
    moved = f"flatten(zip_with(inside, {_so_far('inside.at', '0', 't.now + x', 'int')}, (i, o) -> transform(i.spans, p -> named_struct('start', p.start + o, 'stop', p.stop + o))))"
    placed = f"transform(array({steps}), steps -> transform(array(transform({_blocks('steps')}, block -> {block})), inside -> {moved})[0])[0]"
    return f"transform(array(split({text}, {pattern}, -1)), cut -> CASE WHEN size(cut) < 2 THEN {none} ELSE {placed} END)[0]"


_DETECTION = "struct<start:int,stop:int,label:string,priority:int,weight:double>"


def _tagged(text: str) -> str:
    """SQL: detections of the identifiers joined by AND, OR and WITH behind a tag; the first one's place includes the tag."""
    known = identifiers()
    one = _any_of(known)
    whole = _literal(f" spdx license identifier (?:{one})(?: (?:and|or|with) (?:{one}))*(?= )")
    labels = ", ".join(f"'{t}', '{label}'" for t, label in known.items())
    inner = f"substring({text}, e.start + 1, e.stop - e.start)"
    own = f"transform({_places(inner, _literal(f'(?<= )(?:{one})(?= |$)'))}, (q, i) -> named_struct('start', e.start + if(i = 0, 0, q.start), 'stop', e.start + q.stop, 'label', element_at(map({labels}), substring({inner}, q.start + 1, q.stop - q.start)), 'priority', 4, 'weight', 1.0D))"
    return f"CASE WHEN contains({text}, ' spdx ') THEN flatten(transform({_places(text, whole)}, e -> {own})) ELSE cast(array() AS array<{_DETECTION}>) END"


def _granted_together(text: str) -> str:
    """SQL: detections of the names in a grant of several licenses ('under MIT and GPL v2')."""
    one = _any_of(names for _, _, names, _ in FAMILIES)
    joint = "(?: (?:and|or|and or|as well as))(?: (?:either|both|the|terms|of|under))*"
    whole = _literal(f" (?:{_GRANTS}) under(?: (?:either|both|the|terms|of))* (?:{one})(?: licen[sc]e)?(?:{joint} (?:{one})(?: licen[sc]e)?)+(?= )")
    inner = f"substring({text}, e.start + 1, e.stop - e.start)"
    table = ", ".join(f"named_struct('label', {_literal(label)}, 'pattern', {_literal(f' (?:{names})(?: licen[sc]e)?(?= |$)')})" for label, _, names, _ in FAMILIES)
    own = f"flatten(transform(array({table}), r -> transform({_places(inner, 'r.pattern')}, q -> named_struct('start', e.start + q.start, 'stop', e.start + q.stop, 'label', r.label, 'priority', 3, 'weight', 0.9D))))"
    return f"CASE WHEN contains({text}, ' under ') THEN flatten(transform({_places(text, whole)}, e -> {own})) ELSE cast(array() AS array<{_DETECTION}>) END"


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD + "+")).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Base: places where the words of a phrase of PHRASES stand one after another, whatever lies between them.
    detections: array of (start, stop, label, priority, weight) in characters of the joined words, after
    suppression. score is the largest weight found, 0.9 at least with a base place, else 0. A null text is
    empty: zero counts, null first and last word, empty labels. Repeated rows stay; an empty table gives
    no rows; other columns are not looked at.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    df = df.withColumn("n_words", _count(F.col("text")))
    df = df.withColumn("low", F.lower("text")).withColumn("hint", F.expr(_hint("low")))
    df = df.withColumn("text", F.when(F.col("hint"), F.col("text")).otherwise(F.lit(""))).select("id", "n_words", "text")

    phrases = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        pattern = _literal(f"(?<!{_WORD})(?i:{f'{_GAP}+'.join(words)})(?!{_WORD})")
        phrases.append(f"CASE WHEN contains(lower(text), '{words[-2]}') THEN named_struct('label', '{label}', 'size', {len(words)}, 'cut', split(text, {pattern}, -1)) END")
    df = df.withColumn("hits", F.expr(f"filter(array({', '.join(phrases)}), h -> size(h.cut) > 1)"))
    word = _literal(_WORD + "+")
    df = df.withColumns({
        "n_base": F.expr("aggregate(hits, 0L, (n, h) -> n + size(h.cut) - 1)"),
        "first_word": F.expr(f"array_min(transform(hits, h -> cast(regexp_count(h.cut[0], {word}) AS bigint)))"),
        "last_word": F.expr(f"array_max(transform(hits, h -> n_words - regexp_count(element_at(h.cut, -1), {word}) - h.size))"),
        "base": F.expr("array_sort(array_distinct(hits.label))"),
    })

    every = (*rules(), *text_rules())
    parts = {w: i for i, w in enumerate(dict.fromkeys(w for r in every for x in _needed(r) for w in x))}
    needs = lambda r: "array(" + ", ".join(f"array({', '.join(str(parts[w]) for w in x)})" for x in _needed(r)) + ")"
    table = ", ".join(f"named_struct('label', {_literal(r.label)}, 'needs', {needs(r)}, 'pattern', {_literal(f' (?:{r.pattern})(?= )')}, 'priority', {r.priority}, 'weight', {r.weight}D)" for r in every)
    there = f"transform(array({', '.join(map(_literal, parts))}), w -> contains(joined, w))"
    joined = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.expr(f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"), F.lit(_WORD + "+"), F.lit(0)), " "), F.lit(" "))
    df = df.withColumn("joined", F.when(F.col("text") != "", joined).otherwise(F.lit("")))
    df = df.withColumn("found", F.expr(
        f"CASE WHEN joined = '' THEN cast(array() AS array<{_DETECTION}>) ELSE concat({_tagged('joined')}, {_granted_together('joined')}, "
        f"flatten(transform(transform(array({there}), there -> filter(array({table}), r -> exists(r.needs, x -> forall(x, i -> there[i]))))[0], r -> transform({_places('joined', 'r.pattern')}, "
        "p -> named_struct('start', p.start, 'stop', p.stop, 'label', r.label, 'priority', r.priority, 'weight', r.weight))))) END"
    ))
    # In order of start, then of longer and of higher priority, a detection lies inside an earlier one if an end seen so far, of its priority or a higher one, is not before its own.
    df = df.withColumn("found", F.expr(
        "array_sort(found, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start WHEN x.stop <> y.stop THEN y.stop - x.stop "
        "WHEN x.priority <> y.priority THEN y.priority - x.priority ELSE CASE WHEN x.label < y.label THEN -1 WHEN x.label > y.label THEN 1 ELSE 0 END END)"
    ))
    top = max(r.priority for r in every)
    none = f"array_repeat(-1, {top + 1})"
    ends = f"transform({none}, (e, p) -> coalesce(array_max(transform(filter(block, x -> x.priority >= p), x -> x.stop)), e))"
    kept = (
        f"aggregate(block, named_struct('ends', before, 'kept', cast(array() AS array<{_DETECTION}>)), (s, x) -> named_struct("
        "'ends', transform(s.ends, (e, p) -> CASE WHEN p <= x.priority THEN greatest(e, x.stop) ELSE e END), "
        "'kept', CASE WHEN s.ends[x.priority] >= x.stop THEN s.kept ELSE concat(s.kept, array(x)) END), s -> s.kept)"
    )
    before = _so_far(f"transform(blocks, block -> {ends})", none, "zip_with(t.now, x, (e, n) -> greatest(e, n))", "array<int>")
    df = df.withColumn("detections", F.expr(
        f"CASE WHEN size(found) = 0 THEN found ELSE transform(array({_blocks('found')}), blocks -> flatten(zip_with(blocks, {before}, (block, before) -> {kept})))[0] END"
    ))
    return df.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.col("detections.label")))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.weight"), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)).alias("score"),
        "detections",
    )
