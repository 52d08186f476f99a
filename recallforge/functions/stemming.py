"""The English Snowball stemmer, on words and on Arrow columns of words."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# The published lists of the English stemmer.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = "bb dd ff gg mm nn pp rr tt"
LI_ENDINGS = "cdeghkmnrt"

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_DOUBLE = tuple(DOUBLES.split())
_BY_LENGTH = {n: sorted(s, key=len, reverse=True) for n, s in (("2", STEP_2), ("3", STEP_3), ("4", STEP_4))}


def _ending(word: str, step: str) -> str | None:
    return next((s for s in _BY_LENGTH[step] if word.endswith(s)), None)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return _SHORT.search(word) is not None and (len(word) > 2 or word[0] in "aeiouy")


def stem(word: str) -> str:
    """The stem of one lower-cased word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word.removeprefix("'")))
    first = next((len(p) for p in PREFIXES if w.startswith(p)), None)
    if first is None:
        m = _REGION.search(w)
        first = m.end() if m else len(w)
    m = _REGION.search(w, first)
    second = m.end() if m else len(w)

    w = re.sub("(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[: -2 if len(w) > 4 else -1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w

    end = next((s for s in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(s)), None)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= first:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif first >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    end = _ending(w, "2")
    if end and len(w) - len(end) >= first:
        before = w[-len(end) - 1 : -len(end)]
        if end == "li":
            w = w[:-2] if before and before in LI_ENDINGS else w
        elif end != "ogi" or before == "l":
            w = w[: -len(end)] + STEP_2[end]
    end = _ending(w, "3")
    if end and len(w) - len(end) >= (second if end == "ative" else first):
        w = w[: -len(end)] + STEP_3[end]
    end = _ending(w, "4")
    if end and len(w) - len(end) >= second and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > second or len(w) > first and not _short(w[:-1])) or w.endswith("ll") and len(w) > second:
        w = w[:-1]
    return w.replace("Y", "y")


_known: dict[str, str] = {}


def _stem_of(word: str) -> str:
    found = _known.get(word)
    if found is None:
        if len(_known) > 500_000:
            _known.clear()
        found = _known[word] = stem(word)
    return found


def stem_lists(words: pa.Array) -> pa.Array:
    """An array of word lists with each word stemmed; distinct words of a batch once."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    flat = words.flatten().dictionary_encode()
    stems = pa.array([None if w is None else _stem_of(w) for w in flat.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(words), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, stems.take(flat.indices), mask=words.is_null() if words.null_count else None)


def stemmed(words: Column) -> Column:
    """An array of lower-cased words, each stemmed, Arrow batch by Arrow batch."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return stem_lists(column)

    return run(words)


def _case(column: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in rules) + f" ELSE {column} END"


def _ends(*endings: str) -> str:
    return " OR ".join(f"suffix(w, '{e}')" for e in endings)


def stems_sql(words: str) -> str:
    """Common table expressions that end in stems(word, stem), for the distinct lower-cased
    letters-and-digits words of the relation ``words`` (word)."""
    cut, region = lambda n: f"left(w, len(w) - {n})", lambda n, r: f"len(w) - {n} >= {r}"
    exceptions = ", ".join(f"('{a}', '{b}')" for a, b in EXCEPTIONS.items())
    short = lambda w: f"((len({w}) > 2 AND regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouywxY]$')) OR regexp_matches({w}, '^[aeiouy][^aeiouy]$'))"
    step2 = []
    for e in _BY_LENGTH["2"]:
        n = len(e)
        held = {"li": f" AND regexp_matches(w, '[{LI_ENDINGS}]li$')", "ogi": " AND suffix(w, 'logi')"}.get(e, "")
        step2.append((_ends(e), f"CASE WHEN {region(n, 'r1')}{held} THEN {cut(n)} || '{STEP_2[e]}' ELSE w END"))
    step3 = [(_ends(e), f"CASE WHEN {region(len(e), 'r2' if e == 'ative' else 'r1')} THEN {cut(len(e))} || '{STEP_3[e]}' ELSE w END") for e in _BY_LENGTH["3"]]
    step4 = [(_ends(e), f"CASE WHEN {region(len(e), 'r2')}{' AND (' + _ends('sion', 'tion') + ')' if e == 'ion' else ''} THEN {cut(len(e))} ELSE w END") for e in _BY_LENGTH["4"]]
    off = lambda e: f"CASE WHEN regexp_matches({cut(len(e))}, '[aeiouy]') THEN {cut(len(e))} || '*' ELSE w END"
    step1b = [(_ends(e), f"CASE WHEN {region(len(e), 'r1')} THEN {cut(len(e))} || 'ee' ELSE w END" if "eed" in e else off(e)) for e in ("eedly", "ingly", "edly", "eed", "ing", "ed")]
    return f"""
s0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words} WHERE len(word) > 2 AND word NOT IN ({", ".join(f"'{a}'" for a in EXCEPTIONS)})),
s1 AS (SELECT *, CASE {" ".join(f"WHEN prefix(w, '{p}') THEN {len(p)}" for p in PREFIXES)} WHEN regexp_matches(w, '[aeiouy][^aeiouy]') THEN len(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')) ELSE len(w) END AS r1 FROM s0),
s2 AS (SELECT word, w, r1, r1 + CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]') THEN len(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')) ELSE len(w) - r1 END AS r2 FROM s1),
s3 AS (SELECT word, r1, r2, {_case("w", [(_ends("sses"), cut(2)), (_ends("ied", "ies"), f"left(w, len(w) - CASE WHEN len(w) > 4 THEN 2 ELSE 1 END)"), (_ends("us", "ss"), "w"), ("suffix(w, 's') AND regexp_matches(left(w, len(w) - 2), '[aeiouy]')", cut(1))])} AS w FROM s2),
s4 AS (SELECT word, r1, r2, w, w IN ({", ".join(f"'{k}'" for k in KEPT_AFTER_PLURAL)}) AS done FROM s3),
s5 AS (SELECT * REPLACE ({_case("w", step1b)} AS w) FROM s4 WHERE NOT done),
s6 AS (SELECT * REPLACE ({_case("w", [("NOT suffix(w, '*')", "w"), (_ends("at*", "bl*", "iz*"), f"{cut(1)} || 'e'"), (_ends(*[d + "*" for d in _DOUBLE]), cut(2)), (f"r1 >= len(w) - 1 AND {short(cut(1))}", f"{cut(1)} || 'e'"), ("true", cut(1))])} AS w) FROM s5),
s7 AS (SELECT * REPLACE (CASE WHEN len(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN {cut(1)} || 'i' ELSE w END AS w) FROM s6),
s8 AS (SELECT * REPLACE ({_case("w", step2)} AS w) FROM s7),
s9 AS (SELECT * REPLACE ({_case("w", step3)} AS w) FROM s8),
s10 AS (SELECT * REPLACE ({_case("w", step4)} AS w) FROM s9),
s11 AS (SELECT * REPLACE (CASE WHEN suffix(w, 'e') AND (len(w) > r2 OR (len(w) > r1 AND NOT {short(cut(1))})) OR suffix(w, 'll') AND len(w) > r2 THEN {cut(1)} ELSE w END AS w) FROM s10),
stems AS (SELECT word, replace(w, 'Y', 'y') AS stem FROM s11 UNION ALL SELECT word, w FROM s4 WHERE done UNION ALL SELECT word, word FROM {words} WHERE len(word) <= 2
  UNION ALL SELECT word, to_stem FROM {words} JOIN (VALUES {exceptions}) AS x(word, to_stem) USING (word))"""
