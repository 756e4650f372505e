"""What is known of an index's fields."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class FieldSpec:
    """``index`` is yes, untokenized, or no; ``norms`` False leaves every norm 0, so that scores are 0 too."""

    name: str
    stored: bool = True
    index: str = "yes"
    norms: bool = True
    term_vectors: bool = True
    boost: float = 1.0
    compression: str = "no"

    def __post_init__(self):
        if self.index not in ("yes", "untokenized", "no"):
            raise ValueError(f"unknown index option {self.index!r}")
        if self.term_vectors and self.index == "no":
            object.__setattr__(self, "term_vectors", False)

    @property
    def indexed(self) -> bool:
        return self.index != "no"

    @property
    def tokenized(self) -> bool:
        return self.index == "yes"


@dataclass
class FieldInfos:
    """Specifications by field; an unknown field gets the defaults when it is first met."""

    default: FieldSpec = field(default_factory=lambda: FieldSpec(""))
    specs: dict[str, FieldSpec] = field(default_factory=dict)

    def add(self, spec: FieldSpec) -> FieldInfos:
        self.specs[spec.name] = spec
        return self

    def add_field(self, name: str, **options) -> FieldInfos:
        return self.add(replace(self.default, name=name, **options))

    def __getitem__(self, name: str) -> FieldSpec:
        return self.specs.setdefault(name, replace(self.default, name=name))

    def __iter__(self):
        return iter(self.specs.values())

    def __len__(self) -> int:
        return len(self.specs)

    @property
    def fields(self) -> list[str]:
        return list(self.specs)

    @property
    def indexed_fields(self) -> list[str]:
        return [s.name for s in self if s.indexed]

    @property
    def tokenized_fields(self) -> list[str]:
        return [s.name for s in self if s.tokenized]

    def to_json(self) -> str:
        return json.dumps({"default": asdict(self.default), "fields": [asdict(s) for s in self]})

    @classmethod
    def load(cls, text: str) -> FieldInfos:
        got = json.loads(text)
        infos = cls(FieldSpec(**got["default"]))
        for spec in got["fields"]:
            infos.add(FieldSpec(**spec))
        return infos
