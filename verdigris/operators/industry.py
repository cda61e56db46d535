"""What an industry changes: a registry of overrides, found by key or alias, merged by kind (a scalar, a map, a list of terms).

The registry is configuration, a few modules known before a job starts, so each merge is an expression over the module's key: no join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IndustryModule:
    """Overrides of one industry; what is empty stays as it is for all."""

    key: str
    aliases: tuple[str, ...] = ()
    terms: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    maps: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    scalars: Mapping[str, float] = field(default_factory=dict)


def _plain(text: str) -> str:
    return text.strip().lower().replace(" ", "")


def _by_key(module: Column, values: Mapping[str, Column]) -> Column | None:
    chosen = None
    for key, value in values.items():
        chosen = F.when(module == key, value) if chosen is None else chosen.when(module == key, value)
    return chosen


def module_of(active: Column, industry: Column, registry: Sequence[IndustryModule]) -> Column:
    """The key that is named, if the registry has it, and no other; where none is named, the first module with an alias within the industry's
    name, blanks and case left out; else null."""
    told = F.replace(F.lower(F.trim(industry)), F.lit(" "), F.lit(""))
    named = F.when(active.isin([m.key for m in registry]), active) if registry else F.lit(None).cast("string")
    inferred = F.coalesce(*[F.when(F.contains(told, F.lit(_plain(a))), m.key) for m in registry for a in m.aliases], F.lit(None).cast("string"))
    return F.when(F.coalesce(active, F.lit("")) != "", named).otherwise(inferred)


def scalar(module: Column, name: str, default: float, registry: Sequence[IndustryModule]) -> Column:
    """The industry's value where it has one."""
    own = _by_key(module, {m.key: F.lit(m.scalars[name]) for m in registry if name in m.scalars})
    return F.lit(default) if own is None else F.coalesce(own, F.lit(default))


def merged_map(module: Column, name: str, default: Mapping[str, float], registry: Sequence[IndustryModule]) -> dict[str, Column]:
    """Every key of the default and of any industry, with the industry's value over the default's; null where neither has one."""
    keys = dict.fromkeys([*default, *(k for m in registry for k in m.maps.get(name, {}))])
    out = {}
    for k in keys:
        own = _by_key(module, {m.key: F.lit(m.maps[name][k]) for m in registry if k in m.maps.get(name, {})})
        base = F.lit(default.get(k)).cast("double")
        out[k] = base if own is None else F.coalesce(own, base)
    return out


def merged_terms(module: Column, name: str, default: Iterable[str], registry: Sequence[IndustryModule]) -> Column:
    """array<string>: the default terms, then the industry's, each once, in that order."""
    base = list(dict.fromkeys(default))
    listed = lambda terms: F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    own = _by_key(module, {m.key: listed(list(dict.fromkeys([*base, *m.terms[name]]))) for m in registry if m.terms.get(name)})
    return listed(base) if own is None else F.coalesce(own, listed(base))
