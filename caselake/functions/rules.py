"""Ordered rules, flags and labels compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]  # label, regular expression


def _checked(rules):
    if not rules:
        raise ValueError("no rules given")
    return rules


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive search; null text does not match."""
    return F.coalesce(col.rlike(f"(?i){pattern}"), F.lit(False))


def blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~col.rlike(r"\S"), F.lit(True))


def first_match(
    col: Column, rules: Sequence[Rule], null_label: str | None = None, default: str | None = None
) -> Column:
    """Label of the first rule that matches; ``null_label`` for blank text, ``default`` where none matches."""
    out = F.when(blank(col), F.lit(null_label))
    for label, pattern in _checked(rules):
        out = out.when(matches(col, pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def value_or_rules(value: Column, texts: Sequence[Column], rules: Sequence[Rule], default: str) -> Column:
    """The structured value where it is not blank, else the first rule that matches the texts together."""
    given = F.when(~blank(value), F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.coalesce(given, first_match(F.concat_ws(" ", *texts), rules, default, default))


def first_match_index(col: Column, rules: Sequence[Rule]) -> Column:
    """Position of the first rule that matches, -1 for none, null for blank text: rules that share a label stay apart."""
    out = F.when(blank(col), F.lit(None).cast("int"))
    for i, (_, pattern) in enumerate(_checked(rules)):
        out = out.when(matches(col, pattern), F.lit(i))
    return out.otherwise(F.lit(-1))


def first_match_with_veto(
    col: Column,
    rules: Sequence[tuple[str, str, str | None]],
    low_value: str | None = None,
    context: str | None = None,
) -> Column:
    """(label, pattern, veto) rules: a rule counts unless its veto matches too.

    Text that matches ``low_value`` gets no label unless it also matches ``context``.
    """
    out = None
    for label, pattern, veto in _checked(rules):
        hit = matches(col, pattern)
        if veto:
            hit = hit & ~matches(col, veto)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    out = out.otherwise(F.lit(None))
    if low_value:
        poor = matches(col, low_value)
        if context:
            poor = poor & ~matches(col, context)
        out = F.when(~poor, out)
    return out


def first_case(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first condition that holds, over any columns: buckets, ranks, verdicts, statuses."""
    out = None
    for condition, value in _checked(cases):
        value = value if isinstance(value, Column) else F.lit(value)
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def flag_columns(rules: Mapping[str, Sequence[tuple[str, str]]]) -> dict[str, Column]:
    """flag -> [(column, pattern)]: a boolean per flag, true if any clause matches."""
    out = {}
    for flag, clauses in _checked(rules).items():
        hit = F.lit(False)
        for name, pattern in _checked(clauses):
            hit = hit | matches(F.col(name), pattern)
        out[flag] = hit
    return out


def boost_flags(flags: Mapping[str, Column], labels: Column, by_label: Mapping[str, str]) -> dict[str, Column]:
    """Sets a flag also where ``labels`` (an array) holds the label that stands for it."""
    return {
        f: c | F.coalesce(F.array_contains(labels, by_label[f]), F.lit(False)) if f in by_label else c
        for f, c in flags.items()
    }


def multi_label(col: Column, rules: Sequence[Rule]) -> Column:
    """All labels whose pattern matches, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(matches(col, p), F.lit(label)) for label, p in _checked(rules)]))


def contains_any(col: Column, terms: Sequence[str]) -> Column:
    """Whether lower-cased text holds any of the terms."""
    low, out = F.lower(col), F.lit(False)
    for t in _checked(terms):
        out = out | F.coalesce(low.contains(t.lower()), F.lit(False))
    return out


def keyword_hits(col: Column, terms: Sequence[str]) -> Column:
    """How many of the terms are found, each counted once."""
    low = F.lower(F.coalesce(col, F.lit("")))
    return sum((low.contains(t.lower()).cast("int") for t in _checked(terms)), F.lit(0))


def value_map(col: Column, mapping: Mapping[str, str], keep_other: bool = True) -> Column:
    """Looks up the trimmed, lower-cased value; other values stay as they are or become null."""
    key = F.lower(F.trim(col))
    pairs = [F.lit(x) for kv in _checked(mapping).items() for x in (kv[0].lower(), kv[1])]
    found = F.element_at(F.create_map(*pairs), key)
    return F.coalesce(found, col) if keep_other else found


def contains_ladder(col: Column, ladder: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """Label of the first rung of which the lower-cased text contains a term."""
    return first_case([(contains_any(col, terms), label) for label, terms in _checked(ladder)], default)


def backend(url: Column, portal: Column, ladder: Sequence[tuple[str, Sequence[str]]], known: str, default: str) -> Column:
    """Backend of a case: by address, but ``known`` portals first; blank addresses are ``no_url``, or ``known_no_url`` for those portals."""
    own = F.coalesce(portal == known, F.lit(False))
    blank_url = url.isNull() | (url == "")
    return first_case([(blank_url & own, f"{known}_no_url"), (blank_url, "no_url"), (own, known)], contains_ladder(url, ladder, default))


def route_family(authority: Column, url: Column, routes: Sequence[tuple[str, str, str, bool]]) -> Column:
    """Recovery family of a known landing page, else null.

    ``routes``: (family, authority, address, whole): the authority in lower case, and the address in lower case without
    slashes at its end, or, unless ``whole``, a part of it.
    """
    name, address = F.lower(F.trim(authority)), F.lower(F.trim(url))
    bare = F.regexp_replace(address, "/+$", "")
    return first_case([((name == a) & ((bare == u) if whole else address.contains(u)), family) for family, a, u, whole in _checked(routes)])


Clause = tuple[str | tuple[str, ...], str, object]  # column or columns, operator, value


def clause(columns: str | Sequence[str], operator: str, value) -> Column:
    """Condition of one clause, false for null; several columns are read as one text, parted by spaces.

    ``in``: the trimmed, lower-cased value is one of several; ``contains``: the lower-cased text holds one of several terms; ``matches``: a regular
    expression, whatever the case; ``filled``: whether there is more than white space.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    text = F.col(names[0]) if len(names) == 1 else F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names])
    if operator == "in":
        found = F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")).isin(*value)
    elif operator == "contains":
        found = contains_any(text, value)
    elif operator == "matches":
        found = matches(text, value)
    elif operator == "filled":
        found = ~blank(text) if value else blank(text)
    else:
        raise ValueError(f"unknown operator: {operator}")
    return F.coalesce(found, F.lit(False))


def compile_ladder(rules: Sequence[tuple[object, Sequence[Sequence[Clause]]]], default: object = None) -> Column:
    """Result of the first rule that holds: ``(result, alternatives)``, of which all clauses of one must hold.

    Rules are data, over any columns.  Results may be values or Columns, for instance structs (:func:`rank`).
    """
    cases = []
    for result, alternatives in _checked(rules):
        holds = F.lit(False)
        for clauses in _checked(alternatives):
            every = F.lit(True)
            for c in _checked(clauses):
                every = every & clause(*c)
            holds = holds | every
        cases.append((holds, result))
    return first_case(cases, default)


def rank(primary: int | Column, tie_break: int | Column = 0) -> Column:
    """A rank of two levels, ordered by the first and then the second."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(primary).alias("primary"), as_column(tie_break).alias("tie_break"))


def sheet_class(source: Column, sheet: Column, columns: Column, rows: Column, confidence: Column) -> Column:
    """(class, reason, review) of a sheet from its file, its name, its size and the confidence in its header row."""
    file, name = F.lower(source), F.lower(sheet)
    casework = file.contains("casework_database") | file.contains("older_casework")
    main = name.isin("data set", "dataset") | ((columns >= 15) & (rows >= 1000))
    annex = name.startswith("annex a") | name.startswith("annex b") | name.startswith("annex c")
    unsure = confidence < 0.03
    no, yes = F.lit(False), F.lit(True)
    verdicts = [
        (casework & main, "case_level", "casework main dataset sheet", confidence < 0.05),
        (casework, "metadata_chart", "casework workbook support/reference sheet", yes),
        (name.contains("table of contents"), "exclude", "index/contents sheet", no),
        (name.rlike("figure|graph|virtual events"), "metadata_chart", "chart helper/figure sheet", no),
        (name.contains("bqr"), "metadata_chart", "background quality report helper sheet", no),
        (name.rlike("^table|by procedure|by casework type"), "aggregate_timeseries", "tabular quarterly statistics", unsure),
        (annex & (rows >= 20) & (columns >= 3), "aggregate_timeseries", "annex tabular statistics", unsure),
        (annex, "metadata_chart", "annex notes/chart support", yes),
        ((columns <= 1) & (rows <= 30), "exclude", "single-cell note/title sheet", no),
        ((rows >= 15) & (columns >= 2), "aggregate_timeseries", "default statistical table classification", unsure),
    ]

    def row(label: str, reason: str, review: Column) -> Column:
        return F.struct(F.lit(label).alias("class"), F.lit(reason).alias("reason"), review.alias("review"))

    return first_case([(c, row(*v)) for c, *v in verdicts], row("metadata_chart", "fallback non-tabular sheet", yes))
