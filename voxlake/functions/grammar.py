"""Two short parameter notations, read once on the driver: channel choices and mask modes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a mask mode, in the order in which a mode is written, and its short names.
MASK_ATOMS = ("feat", "affine", "elastic")
MASK_ALIASES = {"none": (), "all": MASK_ATOMS, "reg": ("affine", "elastic")}


def channels(spec: str | int | slice | Sequence[int] | None, size: int) -> list[int]:
    """Indexes from 0 out of `size` channels: None or `:` for all, `a:b:c` and `[a:b:c]`, `3` and `[3]`, `0,2,4`,
    `[0,2,4]`, or such lists, tuples, slices and numbers themselves. Negative indexes count from the end."""
    if spec is None:
        return [*range(size)]
    if isinstance(spec, slice):
        return [*range(size)[spec]]
    if isinstance(spec, int):
        spec = [spec]
    if isinstance(spec, str):
        text = spec.strip()
        text = text[1:-1].strip() if text[:1] in "[(" and text[-1:] in "])" else text
        if ":" in text:
            parts = [p.strip() for p in text.split(":")]
            if len(parts) > 3 or not all(re.fullmatch(r"(-?\d+)?", p) for p in parts):
                raise ValueError(f"no channel choice: {spec!r}")
            return [*range(size)[slice(*(int(p) if p else None for p in parts))]]
        try:
            spec = [int(p) for p in text.split(",") if p.strip()]
        except ValueError as error:
            raise ValueError(f"no channel choice: {spec!r}") from error
    found = [int(k) + size if int(k) < 0 else int(k) for k in spec]
    if any(not 0 <= k < size for k in found):
        raise IndexError(f"{spec!r} leaves the {size} channels")
    return found


def select(feat: Column, spec, size: int) -> Column:
    """The chosen channels of a vector of `size` components."""
    found = channels(spec, size)
    if found and found == [*range(found[0], found[0] + len(found))]:
        return F.slice(feat, found[0] + 1, len(found))
    return F.array(*[F.element_at(feat, k + 1) for k in found]) if found else F.slice(feat, 1, 0)


def select_all(rows: DataFrame, spec, sizes: Mapping[str, int]) -> DataFrame:
    """rows with the same choice of channels in every column of sizes (column -> channels): a pack's views stay alike. A choice that leaves the
    channels of one of them is an error before anything is read."""
    return rows.withColumns({name: select(F.col(name), spec, size) for name, size in sizes.items()})


def mask_mode(text: str) -> str:
    """The usual form of a mode such as `elastic+feat`: atoms without repeats, in their order, or `none`."""
    wanted: set[str] = set()
    for part in (p.strip().lower() for p in text.split("+")):
        if part in MASK_ALIASES:
            wanted.update(MASK_ALIASES[part])
        elif part in MASK_ATOMS:
            wanted.add(part)
        else:
            raise ValueError(f"unknown mask mode {part!r} in {text!r}")
    return "+".join(a for a in MASK_ATOMS if a in wanted) or "none"


def mask_modes(text: Column) -> Column:
    """`mask_mode` of a column; an unknown part is an error where it is read."""
    part = lambda p: F.lower(F.trim(p))
    known = F.create_map(*[x for k, atoms in (*MASK_ALIASES.items(), *((a, (a,)) for a in MASK_ATOMS)) for x in (F.lit(k), F.array(*map(F.lit, atoms)).cast("array<string>"))])
    atoms = F.flatten(F.transform(F.split(text, "[+]"), lambda p: F.coalesce(F.element_at(known, part(p)), F.raise_error(F.concat(F.lit("unknown mask mode "), p)).cast("array<string>"))))
    found = F.array_join(F.filter(F.array(*map(F.lit, MASK_ATOMS)), lambda a: F.array_contains(atoms, a)), "+")
    return F.when(found == "", "none").otherwise(found)


def registration_stages(mode: Column) -> Column:
    """`registration_masks` of a column of modes in their usual form."""
    affine, elastic = (F.array_contains(F.split(mode, "[+]"), x) for x in ("affine", "elastic"))
    return F.when(affine & elastic, "both").when(affine, "affine").when(elastic, "elastic").otherwise("none")


def registration_masks(mode: str) -> str:
    """Which registration stages a mode masks: none, affine, elastic or both."""
    parts = set(mask_mode(mode).split("+"))
    return {(False, False): "none", (True, False): "affine", (False, True): "elastic", (True, True): "both"}["affine" in parts, "elastic" in parts]
