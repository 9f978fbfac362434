"""What parsers give: a struct of flat fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import those, to_map

FIELDS = {
    "timestamp_text": "string", "category": "string", "type": "string", "action": "string", "severity": "string", "severity_id": "int", "message": "string",
    "src_ip": "string", "src_port": "int", "src_host": "string", "src_user": "string", "src_zone": "string",
    "dst_ip": "string", "dst_port": "int", "dst_host": "string", "dst_zone": "string", "protocol": "string", "direction": "string",
    "vendor": "string", "product": "string", "observer_host": "string", "observer_version": "string", "raw_format": "string",
    "extensions": "map<string,string>", "confidence": "map<string,int>", "error": "string",
}


def parsed(**given: Column | str | int) -> Column:
    """The struct, nulls where nothing is given."""
    values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items()}
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def failed(message: str) -> Column:
    return parsed(error=message)


def confidences(*pairs: tuple[str, int, Column | None]) -> Column:
    """Confidence, in hundredths, of each field whose condition holds (None: always)."""
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    return F.map_from_entries(those("struct<key:string,value:int>", *[(c, entry(k, v)) for k, v, c in pairs]))


class Work:
    """Intermediate columns of all parsers, in layers. A value that many fields need is computed once, in a projection of its own,
    for the rows of its parser only; a layer may refer to the layers before it."""

    def __init__(self) -> None:
        self.layers: dict[int, dict[str, Column]] = {}
        self._prefix, self._guard = "", F.lit(True)

    def of(self, name: str, guard: Column) -> Work:
        """The same layers, for one parser's rows."""
        one = Work()
        one.layers, one._prefix, one._guard = self.layers, f"_{name}_", guard
        return one

    def keep(self, layer: int, name: str, value: Column, when: Column | None = None) -> Column:
        guard = self._guard if when is None else self._guard & when
        self.layers.setdefault(layer, {})[self._prefix + name] = F.when(guard, value)
        return F.col(self._prefix + name)

    def kv(self, layer: int, name: str, text: Column, pattern: str, value: int, lower: bool = False, when: Column | None = None) -> Column:
        """A map of key=value finds; takes two layers."""
        keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        keys = self.keep(layer, f"{name}_keys", F.transform(keys, F.lower) if lower else keys, when)
        values = self.keep(layer, f"{name}_values", F.regexp_extract_all(text, F.lit(pattern), F.lit(value)), when)
        return self.keep(layer + 1, name, to_map(keys, values), when)


@dataclass(frozen=True)
class Parser:
    """A parser: which lines it takes (raw, format), and its struct (work, raw, line without outer white space, received_at)."""

    name: str
    format_type: str
    takes: Callable[[Column, Column], Column]
    parse: Callable[[Work, Column, Column, Column], Column]
    version: str = "1.0.0"
    active: bool = True
    baseline: float = 0.95
