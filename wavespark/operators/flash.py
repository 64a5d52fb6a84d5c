"""Command sets of serial flash memories, as they stand in JSON files: what a frame looks like behind each opcode, and how it
changes the device's mode.

A file has ``format``, ``version``, ``name``, ``source``, ``comment`` and ``commands``. A command has ``code`` (hexadecimal, or several), ``name``,
the lines of command, address and data in each protocol (``extended``, ``dual``, ``quad``: ``"1-4-4"``), ``address`` (bytes), ``dummy`` (clocks: one number, or
one for each protocol), ``data`` (``read``, ``write``, ``none``), ``dtr`` (address and data on both clock edges), ``dummy_setting`` (the dummy clocks can be set), ``xip``
(IO0 on the first dummy clock says whether the next frames go on without a command) and ``effects``.

An effect has ``set`` (``protocol``, ``dtr``, ``dummy``, ``address_bytes``, ``xip``, ``reset``), and a ``value``, or ``bits`` (``"7:4"``) of the data byte ``byte`` with ``values`` by
their binary digits; ``after`` is the opcode that the frame before must have had. Keys that aren't known are errors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path
from typing import Any

FORMAT, VERSION = "spi-command-set", 1
PROTOCOLS = {"extended": 1, "dual": 2, "quad": 4}
DIRECTIONS = ("none", "read", "write")
#: What each target of an effect may be set to.
TARGETS = {
    "protocol": lambda v: v in PROTOCOLS,
    "dtr": lambda v: isinstance(v, bool),
    "dummy": lambda v: v == "default" or type(v) is int and 0 <= v <= 254,
    "address_bytes": lambda v: type(v) is int and v in (3, 4),
    "xip": lambda v: isinstance(v, bool),
    "reset": lambda v: True,
}


@dataclass(frozen=True)
class Effect:
    target: str
    value: Any = None
    byte: int = 0
    bits: tuple[int, int] | None = None
    values: tuple[tuple[int, Any], ...] = ()
    after: int | None = None

    def of(self, data: list[int | None]) -> Any:
        """What the target becomes, by the frame's data bytes (None: unknown); None if it stays. ``default`` is a dummy count."""
        if self.bits is None:
            return True if self.target == "reset" else self.value
        byte = data[self.byte] if self.byte < len(data) else None
        if byte is None:
            return None
        high, low = self.bits
        part = byte >> low & (1 << high - low + 1) - 1
        return dict(self.values).get(part, part if self.target == "dummy" else None)


@dataclass(frozen=True)
class Command:
    code: int
    name: str
    formats: tuple[tuple[int, int, int] | None, ...]
    address: int = 0
    dummy: tuple[int, int, int] = (0, 0, 0)
    data: str = "none"
    dtr: bool = False
    dummy_setting: bool = False
    xip: bool = False
    effects: tuple[Effect, ...] = field(default=())

    def lines(self, protocol: int) -> tuple[int, int, int]:
        """Lines of command, address and data; a protocol that the file leaves out takes all of its lines."""
        own = self.formats[(1, 2, 4).index(protocol)]
        return own or tuple(protocol if n else 0 for n in next(f for f in self.formats if f))

    def clocks(self, protocol: int) -> int:
        return self.dummy[(1, 2, 4).index(protocol)]


class CommandSetError(ValueError):
    """What is wrong in a file, and in which entry."""


def _need(holds: bool, where: str, what: str) -> None:
    if not holds:
        raise CommandSetError(f"{where}: {what}")


def _keys(data: Any, known: str, where: str) -> None:
    _need(isinstance(data, dict), where, "an object is needed")
    more = sorted(data.keys() - set(known.split()))
    _need(not more, where, f"unknown keys: {', '.join(more)}")


def _code(value: Any, where: str) -> int:
    if type(value) is not int:
        _need(isinstance(value, str) and re.fullmatch(r"\s*(0x)?[0-9a-fA-F]{1,2}h?\s*", value) is not None, where, f"{value!r} is no opcode")
        value = int(re.sub(r"^0x|h$", "", value.strip()), 16)
    _need(0 <= value <= 255, where, f"{value} is no opcode")
    return value


def _effect(data: Any, where: str) -> Effect:
    _keys(data, "set value byte bits values after comment", where)
    target = data.get("set")
    _need(target in TARGETS, where, f"{target!r} can't be set")
    fits, after = TARGETS[target], _code(data["after"], where) if "after" in data else None
    if "bits" not in data:
        _need("values" not in data and "byte" not in data, where, "values and byte need bits")
        _need(fits(data.get("value")), where, f"{target} can't be {data.get('value')!r}")
        return Effect(target, data.get("value"), after=after)
    ends = re.fullmatch(r"\s*([0-7])\s*(?::\s*([0-7])\s*)?", str(data["bits"]))
    _need(ends is not None and "value" not in data, where, "bits are such as 7:6 or 3, and there is no value beside them")
    high, low = int(ends[1]), int(ends[2] or ends[1])
    byte, values = data.get("byte", 0), data.get("values", {})
    _need(high >= low and type(byte) is int and 0 <= byte <= 255, where, "bits go from high to low in a byte from 0 to 255")
    _need(isinstance(values, dict) and all(re.fullmatch(f"[01]{{{high - low + 1}}}", k) and fits(v) for k, v in values.items()), where, "values are by all digits of the bits")
    _need(target == "dummy" or bool(values) and target != "reset", where, f"{target} needs values")
    return Effect(target, None, byte, (high, low), tuple((int(k, 2), v) for k, v in values.items()), after)


def parse(items: Any, where: str = "commands") -> tuple[Command, ...]:
    """Commands of a file's list."""
    _need(isinstance(items, list) and bool(items), where, "a list of commands is needed")
    out: dict[int, Command] = {}
    for i, data in enumerate(items, 1):
        here = f"{where}, entry {i}"
        _keys(data, "code name extended dual quad address dummy data dtr dummy_setting xip effects comment", here)
        _need("code" in data, here, "there is no code")
        formats: list[tuple[int, int, int] | None] = []
        for protocol in PROTOCOLS:
            text = str(data.get(protocol) or "").replace(" ", "")
            _need(not text or re.fullmatch("[0124](-[0124]){2}", text) is not None, here, f"{protocol} is such as 1-4-4")
            formats.append(tuple(map(int, text.split("-"))) if text else None)
        _need(any(formats), here, "there is no protocol")
        dummy = data.get("dummy", 0)
        dummy = dummy if isinstance(dummy, list) else [dummy] * 3
        _need(len(dummy) == 3 and all(type(d) is int and 0 <= d <= 255 for d in dummy), here, "dummy is one number, or three")
        _need(type(data.get("address", 0)) is int and 0 <= data.get("address", 0) <= 4, here, "an address has 0 to 4 bytes")
        _need(data.get("data", "none") in DIRECTIONS, here, f"data is one of {DIRECTIONS}")
        _need(all(isinstance(data.get(k, False), bool) for k in ("dtr", "dummy_setting", "xip")) and isinstance(data.get("effects", []), list), here, "flags are true or false, effects a list")
        effects = tuple(_effect(e, f"{here}, effect {k}") for k, e in enumerate(data.get("effects", []), 1))
        _need(not (data.get("dummy_setting") and any(e.bits for e in effects)), here, "effects can't read data behind dummy clocks that can be set")
        for code in data["code"] if isinstance(data["code"], list) else [data["code"]]:
            code = _code(code, here)
            _need(code not in out, here, f"{code:02X} is there already")
            name = str(data.get("name") or "").strip() or f"CMD {code:02X}"
            out[code] = Command(code, name, tuple(formats), data.get("address", 0), tuple(dummy), data.get("data", "none"), data.get("dtr", False), data.get("dummy_setting", False), data.get("xip", False), effects)
    return tuple(out.values())


def load(path: str | Path) -> tuple[str, tuple[Command, ...]]:
    """The name and the commands of a file."""
    return _read(Path(path).read_text("utf-8-sig"), Path(path).name)


def _read(text: str, where: str) -> tuple[str, tuple[Command, ...]]:
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise CommandSetError(f"{where}: no JSON in line {e.lineno}, column {e.colno}") from None
    _keys(data, "format version name source comment commands", where)
    _need(data.get("format", FORMAT) == FORMAT and data.get("version", VERSION) == VERSION, where, f"format {FORMAT} of version {VERSION} is needed")
    return str(data.get("name") or where.rsplit(".", 1)[0]), parse(data.get("commands"), where)


def dump(name: str, commands: Iterable[Command], source: str = "") -> str:
    """The text of a file that ``load`` reads the same commands from."""

    def effect(e: Effect) -> dict:
        out: dict[str, Any] = {"set": e.target}
        if e.bits:
            high, low = e.bits
            out |= {"byte": e.byte, "bits": f"{high}:{low}", "values": {f"{k:0{high - low + 1}b}": v for k, v in e.values}}
        elif e.target != "reset":
            out["value"] = e.value
        return out | ({} if e.after is None else {"after": f"{e.after:02X}"})

    def command(c: Command) -> dict:
        lines = {p: "-".join(map(str, f)) for p, f in zip(PROTOCOLS, c.formats, strict=True) if f}
        more = {"address": c.address, "dummy": list(c.dummy) if any(c.dummy) else 0, "data": "" if c.data == "none" else c.data, "dtr": c.dtr, "dummy_setting": c.dummy_setting, "xip": c.xip, "effects": [effect(e) for e in c.effects]}
        return {"code": f"{c.code:02X}", "name": c.name} | lines | {k: v for k, v in more.items() if v}

    head = {"format": FORMAT, "version": VERSION, "name": name} | ({"source": source} if source else {})
    return json.dumps(head | {"commands": [command(c) for c in commands]}, ensure_ascii=False, indent=1) + "\n"


def common() -> tuple[Command, ...]:
    """The commands that serial NOR flashes share, of the file beside this module."""
    return _read(resources.files(__package__).joinpath("flash_common.json").read_text("utf-8"), "flash_common.json")[1]
