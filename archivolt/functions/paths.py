"""Path columns: identity, folders, containment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from archivolt.functions.text import _col


def normalise(c) -> Column:
    """Portable separators: every backslash becomes a slash."""
    return F.replace(_col(c), F.lit("\\"), F.lit("/"))


def base_name(c) -> Column:
    return F.substring_index(_col(c), "/", -1)


def folder(c) -> Column:
    """Everything before the last slash, '' for a bare name."""
    return F.regexp_extract(_col(c), r"(?s)^(.*)/[^/]*$", 1)


def extension(c) -> Column:
    """Lower-cased suffix with its dot; '' for none or a leading-dot name."""
    return F.lower(F.regexp_extract(base_name(c), r"(?s)[^.].*?(\.[^.]*)$", 1))


def resolve(c) -> Column:
    """Parts of a path with '.' dropped and '..' folded into its parent."""
    parts = F.filter(F.split(normalise(c), "/"), lambda p: (p != "") & (p != "."))
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))),
    )


def relative_to(c, base) -> Column:
    """Path below ``base``, or null when it is not a true descendant.

    Works on the text of absolute paths; links are not followed.
    """
    inner, outer = resolve(c), resolve(base)
    below = (F.size(inner) > F.size(outer)) & (F.slice(inner, F.lit(1), F.size(outer)) == outer)
    return F.when(below, F.array_join(F.slice(inner, F.size(outer) + 1, F.size(inner)), "/"))


def folder_levels(c) -> Column:
    """First- and second-level folders of a relative path, as an array."""
    parts = F.split(folder(c), "/")
    one = F.get(parts, F.lit(0))
    return F.filter(
        F.array(
            F.when((one != "") & ~one.startswith("."), one),
            F.when((F.size(parts) > 1) & ~one.startswith(".") & ~F.get(parts, F.lit(1)).startswith("."),
                   F.concat(one, F.lit("/"), F.get(parts, F.lit(1)))),
        ),
        lambda p: p.isNotNull(),
    )
