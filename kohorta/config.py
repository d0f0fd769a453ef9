"""Configurations with validation and a YAML round trip."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields
from enum import StrEnum
from pathlib import Path
from typing import Any


class LinkMode(StrEnum):
    """How a member's file comes from the store."""

    SYMLINK = "symlink"
    HARDLINK = "hardlink"
    COPY = "copy"


class CodePolicy(StrEnum):
    """A member's code table: the parent's, or its own codes' rows."""

    COPY = "copy"
    PRUNE = "prune"


class SplitPolicy(StrEnum):
    """The splits that are not subsetted: the parent's files, their own first subjects, or none."""

    PASSTHROUGH = "passthrough"
    SUBSET = "subset"
    DROP = "drop"


LINKS, CODE_POLICIES, SPLIT_POLICIES = tuple(LinkMode), tuple(CodePolicy), tuple(SplitPolicy)
DEFAULT_SALT = "kohorta"


def _positive(name: str, value: Any) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer; got {value!r}")


def _one_of(name: str, value: str, allowed: type[StrEnum]) -> StrEnum:
    try:
        return allowed(value)
    except ValueError:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}") from None


def _template(text: str, key: str) -> None:
    """A template must give different numbers different names, and names that are one path component."""
    try:
        a, b = text.format(**{key: 1}), text.format(**{key: 2})
    except (KeyError, IndexError, ValueError) as e:
        raise ValueError(f"bad name template {text!r}: {e}") from e
    if a == b or not re.fullmatch(r"[^/.][^/]*", a):
        raise ValueError(f"bad name template {text!r}")


class _Config:
    def to_dict(self) -> dict[str, Any]:
        plain = {tuple: list, LinkMode: str, CodePolicy: str, SplitPolicy: str}
        return {k: plain.get(type(v), lambda x: x)(v) for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, values: dict[str, Any]):
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False), encoding="utf-8")

    @classmethod
    def from_yaml(cls, path: str | Path):
        return cls.from_dict(load_mapping(path))


def load_mapping(path: str | Path) -> dict[str, Any]:
    """The settings of a YAML file; an empty file has none."""
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            documents = [d for d in yaml.safe_load_all(f) if d is not None]
        except yaml.YAMLError as e:
            raise ValueError(f"{path} is not YAML: {e}") from e
    if any(not isinstance(d, dict) for d in documents) or len(documents) > 1:
        raise ValueError(f"{path} holds something else than one mapping")
    return dict(*documents)


@dataclass(frozen=True)
class SubsetConfig(_Config):
    n_subjects: tuple[int, ...]
    salt: str = DEFAULT_SALT
    n_subjects_per_shard: int = 10_000
    link_mode: str = LinkMode.SYMLINK
    code_metadata: str = CodePolicy.PRUNE
    non_train_policy: str = SplitPolicy.PASSTHROUGH
    train_split: str = "train"
    name_template: str = "N{n:07d}"

    def __post_init__(self) -> None:
        sizes = (self.n_subjects,) if isinstance(self.n_subjects, int) else tuple(self.n_subjects)
        for n in sizes:
            _positive("n_subjects", n)
        if not sizes:
            raise ValueError("n_subjects is empty")
        object.__setattr__(self, "n_subjects", tuple(sorted(set(sizes))))
        _positive("n_subjects_per_shard", self.n_subjects_per_shard)
        for name, kind in (("link_mode", LinkMode), ("code_metadata", CodePolicy), ("non_train_policy", SplitPolicy)):
            object.__setattr__(self, name, _one_of(name, getattr(self, name), kind))
        if not self.salt or not self.train_split:
            raise ValueError("salt and train_split must not be empty")
        _template(self.name_template, "n")

    def subset_name(self, n: int) -> str:
        return self.name_template.format(n=n)


@dataclass(frozen=True)
class ResampleConfig(_Config):
    n_resamples: int
    size: int
    replace: bool = True
    salt: str = DEFAULT_SALT
    allow_overlap: bool = False
    source_split: str = "train"
    name_template: str = "boot_{i:03d}"

    def __post_init__(self) -> None:
        _positive("n_resamples", self.n_resamples)
        _positive("size", self.size)
        if not self.salt or not self.source_split:
            raise ValueError("salt and source_split must not be empty")
        _template(self.name_template, "i")

    def resample_name(self, i: int) -> str:
        return self.name_template.format(i=i)
