"""Scalar functions and predicates as Column expressions; none of them leaves the JVM.

Names follow what they compute: a dotted name is a module path like `pkg.sub.mod`; a signature key counts parameters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- dotted names


def parts(path: Name) -> Column:
    """The non-empty parts of a dotted name."""
    return F.filter(F.split(_c(path), r"\."), lambda x: x != "")


def common_parts(a: Name, b: Name) -> Column:
    """How many leading parts two dotted names share."""
    same = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def module_similarity(a: Name, b: Name) -> Column:
    """Shared leading parts over the longer name's parts: 1 for two empty names, 0 if one is empty."""
    longest = F.greatest(F.size(parts(a)), F.size(parts(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(common_parts(a, b) / longest)


def module_distance(a: Name, b: Name) -> Column:
    """Parts that lead from one dotted name up and down to the other."""
    return F.size(parts(a)) + F.size(parts(b)) - 2 * common_parts(a, b)


def prefixes(path: Name) -> Column:
    """The name and every dotted prefix of it, shortest first; [''] for the empty name."""
    p = parts(path)
    every = F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "."))
    return F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(every)


def in_module(name: Name, module: Name) -> Column:
    """Whether a name is a module or lies in it; the empty module holds only itself."""
    n, m = _c(name), _c(module)
    return F.when(m == "", n == "").otherwise((n == m) | F.startswith(n, F.concat(m, F.lit("."))))


def first_prefix(name: Name, candidates: Sequence[str]) -> Column:
    """The first of candidates that a name is or lies in, in their order; null if none."""
    hit = F.lit(None).cast("string")
    for p in reversed(candidates):
        hit = F.when((_c(name) == p) | F.startswith(_c(name), F.lit(f"{p}.")), F.lit(p)).otherwise(hit)
    return hit


def covered(origin: Name, end: Name, exceptions: Sequence[tuple[str, str]]) -> Column:
    """Whether an exception covers an edge: both ends are, or lie in, the exception's."""
    out = F.lit(False)
    for a, b in exceptions:
        out = out | (first_prefix(origin, [a]).isNotNull() & first_prefix(end, [b]).isNotNull())
    return out


def strip_package(name: Name, package: str) -> Column:
    """A name inside its own package: `pkg.models` is `models`, `pkg` is ''."""
    n = _c(name)
    return F.when(n == package, F.lit("")).when(F.startswith(n, F.lit(f"{package}.")), F.substring(n, len(package) + 2, 1 << 30)).otherwise(n)


def class_of(qualname: Name) -> Column:
    """The enclosing class of a qualified name, '' at top level."""
    return F.coalesce(F.try_element_at(F.split(_c(qualname), r"\."), F.lit(-2)), F.lit(""))


def is_private(name: Name) -> Column:
    """A leading underscore and no dunder."""
    return F.startswith(_c(name), F.lit("_")) & ~is_dunder(name)


def is_dunder(name: Name) -> Column:
    return _c(name).rlike(r"^__.*__$")


# ---- likenesses


def name_similarity(a: Name, b: Name) -> Column:
    """1 less the edit distance over the longer name: 1 for two empty names, 0 if one is empty."""
    x, y = _c(a), _c(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(1.0 - F.levenshtein(x, y) / longest)


def bag_likeness(a: Name, b: Name) -> Column:
    """Shared over all words of two arrays without nulls, repeats counted: sums of the lesser and of the greater counts; 0 if one is empty."""
    x, y = _c(a), _c(b)
    tagged = lambda words, side: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    state = lambda shared, w, left: F.struct(shared.alias("shared"), w.alias("w"), left.alias("left"))

    def step(s: Column, e: Column) -> Column:
        # In order, a word's places in a come before those in b, each of which takes one of what is left of them.
        same, one = s["w"] == e["w"], F.lit(1)
        counted = state(s["shared"], e["w"], F.when(same, s["left"] + one).otherwise(one))
        return F.when(e["side"] == 0, counted).when(same & (s["left"] > 0), state(s["shared"] + one, s["w"], s["left"] - one)).otherwise(s)

    merged = F.sort_array(F.concat(tagged(x, 0), tagged(y, 1)))
    score = F.aggregate(merged, state(F.lit(0), F.lit(""), F.lit(0)), step, lambda s: F.round(s["shared"] / (F.size(x) + F.size(y) - s["shared"]), 6))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(score)


def word_set(text: Name) -> Column:
    """Distinct lower-case words: runs of letters, digits and underscores of any script."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def set_jaccard(a: Name, b: Name) -> Column:
    """Common elements over all elements of two arrays without repeats; 0 if both are empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def bag_jaccard(a: Name, b: Name) -> Column:
    """Sum of minima over sum of maxima of two maps of counts; 0 if either is empty."""
    pairs = F.map_values(F.map_zip_with(_c(a), _c(b), lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    total = lambda f: F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + f(p["x"], p["y"]))
    return F.when((F.size(_c(a)) < 1) | (F.size(_c(b)) < 1), F.lit(0.0)).otherwise(total(F.least) / total(F.greatest))


# ---- signature keys: counts of positional-only, positional, *args, keyword-only, **kwargs, defaults, keyword defaults

KEY_PARTS = ("p", "a", "v", "k", "w", "d", "kd")


def signature_key(posonly: Name, pos: Name, vararg: Name, kwonly: Name, kwarg: Name, defaults: Name, kw_defaults: Name) -> Column:
    return F.format_string("p%d-a%d-v%d-k%d-w%d-d%d-kd%d", _c(posonly), _c(pos), _c(vararg).cast("int"), _c(kwonly), _c(kwarg).cast("int"), _c(defaults), _c(kw_defaults))


def key_part(key: Name, part: str) -> Column:
    """One count of a signature key; null if the key isn't one."""
    return F.regexp_extract(_c(key), rf"(?:^|-){part}(\d+)(?:-|$)", 1).try_cast("int")


def extras_only(source: Name, target: Name) -> Column:
    """Whether the target's signature differs only by more optional parameters."""
    s, t = ({p: key_part(k, p) for p in KEY_PARTS} for k in (source, target))
    need = lambda x: x["p"] + x["a"] - x["d"]
    need_kw = lambda x: x["k"] - x["kd"]
    ok = (need(s) == need(t)) & (need_kw(s) == need_kw(t)) & (s["p"] + s["a"] <= t["p"] + t["a"]) & (s["k"] <= t["k"]) & (s["v"] <= t["v"]) & (s["w"] <= t["w"])
    return F.coalesce(ok, F.lit(False))


def same_counts(source: Name, target: Name) -> Column:
    """Whether two signature keys have equal counts, so that at most names differ."""
    out = F.lit(True)
    for p in KEY_PARTS:
        out = out & (key_part(source, p) == key_part(target, p))
    return F.coalesce(out, F.lit(False))


def first_parameter_differs(source: Name, target: Name) -> Column:
    """Whether keys differ by exactly one positional parameter and in nothing else."""
    out = F.abs(key_part(source, "a") - key_part(target, "a")) == 1
    for p in KEY_PARTS:
        if p != "a":
            out = out & (key_part(source, p) == key_part(target, p))
    return F.coalesce(out, F.lit(False))


# ---- texts and identifiers


def normal_docstring(text: Name) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(_c(text), F.lit(""))), r"\s+", " ")


def hash_text(text: Name) -> Column:
    return F.sha2(_c(text), 256)


def canonical_id(role: Name, root: Name, module: Name, qualname: Name, kind: Name, key: Name) -> Column:
    return F.concat_ws(":", *map(_c, (role, root, module, qualname, kind, key)))


def slug(text: Name, fallback: str = "target") -> Column:
    """Lower-case letters, digits and single dashes."""
    s = F.trim(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def unique_slug(text: Name, path: Name, clashes: Column) -> Column:
    """A slug, with eight digits of its path's hash where clashes is true."""
    return F.when(clashes, F.concat(slug(text), F.lit("-"), F.substring(F.sha1(_c(path)), 1, 8))).otherwise(slug(text))


def escape_markdown(text: Name) -> Column:
    return F.regexp_replace(_c(text), r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


def parse_edge(text: Name) -> Column:
    """`a -> b` as a struct (origin, end); null if the text isn't one edge."""
    two = F.transform(F.split(_c(text), "->"), lambda x: F.trim(x))
    good = (F.size(two) == 2) & F.forall(two, lambda x: x != "")
    return F.when(good, F.struct(F.try_element_at(two, F.lit(1)).alias("origin"), F.try_element_at(two, F.lit(2)).alias("end")))


def format_edge(origin: Name, end: Name) -> Column:
    return F.concat_ws(" -> ", _c(origin), _c(end))


def result_id(*fields: Name) -> Column:
    """Sixteen digits of a hash of the fields, joined by bars; nulls are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(_c(f).cast("string"), F.lit("")) for f in fields])), 1, 16)


def mangled(owner: Name, attribute: Name) -> Column:
    """What an attribute is called inside a class: `__x` of `_Own` is `_Own__x`, other names stay."""
    private = F.startswith(_c(attribute), F.lit("__")) & ~F.endswith(_c(attribute), F.lit("__"))
    bare = F.regexp_replace(_c(owner), r"^_+", "")
    return F.when(private & (bare != ""), F.concat(F.lit("_"), bare, _c(attribute))).otherwise(_c(attribute))


def utc_text(ts: Name) -> Column:
    """A time as ISO 8601 in UTC, to the second, ending in Z. The session's time zone has to be UTC."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fill_template(template: str, values: dict[str, Name]) -> Column:
    """A message template with {names} filled in; a null or unknown name gives ?."""
    pieces, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        pieces += [F.lit(template[at : m.start()]), F.coalesce(_c(values[m.group(1)]).cast("string"), F.lit("?")) if m.group(1) in values else F.lit("?")]
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def under_package(module: Name, package: str) -> Column:
    """A module's name below a package: '' for the package itself, null for modules outside it."""
    m = _c(module)
    return F.when(m == package, F.lit("")).when(F.startswith(m, F.lit(f"{package}.")), F.substr(m, F.lit(len(package) + 2)))


def by_suffix(module: Name, suffix: Name) -> Column:
    """What precedes a dotted suffix in a module's name: '' if they are equal, null if the name doesn't end in it."""
    m, s = _c(module), _c(suffix)
    return F.when(m == s, F.lit("")).when((s != "") & F.endswith(m, F.concat(F.lit("."), s)), F.substr(m, F.lit(1), F.length(m) - F.length(s) - 1))


# ---- predicates on names, rules and facts


def name_matches(name: Name, mode: str, own: Name | None = None, names: Sequence[str] = (), pattern: str | None = None) -> Column:
    """any; exact: the reference's own name; alias: that or one of names; names: one of names; regex: the whole name."""
    n = _c(name)
    if mode == "any":
        return n.isNotNull()
    if mode == "regex":
        if pattern is None:
            raise ValueError("name_match='regex' needs a pattern")
        return F.rlike(n, F.lit(f"^(?:{pattern})$"))
    listed = n.isin(list(names)) if names else F.lit(False)
    if mode == "names":
        return listed
    if own is None or mode not in ("exact", "alias"):
        raise ValueError(f"unknown name_match {mode!r}, or no name of the reference's to compare")
    return (n == _c(own)) if mode == "exact" else (n == _c(own)) | listed


def is_problem(status: Name) -> Column:
    """Whether a result is neither fine nor skipped; a null status is a problem."""
    return F.coalesce(~_c(status).isin("OK", "SKIPPED"), F.lit(True))


def rule_matches(rule_id: Name, wanted: Sequence[str]) -> Column:
    """Whether a rule's identifier `marker@entity` starts with one of the wanted texts, or has one as its marker."""
    out = F.lit(False)
    for w in wanted:
        out = out | F.startswith(_c(rule_id), F.lit(w)) | (F.substring_index(_c(rule_id), "@", 1) == w)
    return out


def signature_fits(fact: Name, signature: Name) -> Column:
    """Whether every key that a catalogue entry declares (a map) has the same value in a fact (a map)."""
    return F.forall(F.map_keys(_c(signature)), lambda k: F.coalesce(F.try_element_at(_c(fact), k) == F.try_element_at(_c(signature), k), F.lit(False)))


# ---- order


def in_order(stages: Name, required: Sequence[str]) -> Column:
    """How many of the required stages an array meets in order, taken greedily."""
    want = F.array(*[F.lit(s) for s in required])
    return F.aggregate(_c(stages), F.lit(0), lambda n, s: F.when(F.coalesce(F.try_element_at(want, n + 1) == s, F.lit(False)), n + 1).otherwise(n))


def first_out_of_order(stages: Name, required: Sequence[str]) -> Column:
    """Whether, met greedily, a required stage comes before one that has to precede it."""
    want = F.array(*[F.lit(s) for s in required])
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("bad"))

    def step(state: Column, s: Column) -> Column:
        hit = F.coalesce(F.try_element_at(want, state["n"] + 1) == s, F.lit(False))
        later = F.array_contains(F.slice(want, state["n"] + 2, F.lit(len(required))), s)
        return F.when(state["bad"], state).when(hit, F.struct((state["n"] + 1).alias("n"), F.lit(False).alias("bad"))).otherwise(F.struct(state["n"].alias("n"), later.alias("bad")))

    return F.aggregate(_c(stages), start, step)["bad"]
