"""Permission modes: octal and symbolic parsing, printing, device numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class ModeError(ValueError):
    """A mode that can't be parsed."""


def parse_mode(text: str, directory: bool = False) -> int:
    """An octal mode up to 7777, or chmod's symbolic language from no bits; X counts on
    directories only (or where an execute bit is set already)."""
    if re.fullmatch("[0-7]+", text):
        if (mode := int(text, 8)) > 0o7777:
            raise ModeError(text)
        return mode
    mode = 0
    for clause in text.split(","):
        m = re.fullmatch(r"([ugoa]*)((?:[-+=][rwxXst]*|[-+=][ugo])+)", clause)
        if not m:
            raise ModeError(text)
        who = m[1] or "a"
        who = "ugo" if "a" in who else who
        shift = {"u": 6, "g": 3, "o": 0}
        for op, what in re.findall(r"([-+=])([rwxXst]*|[ugo])", m[2]):
            bits = 0
            for w in who:
                for c in what:
                    if c in "rwx":
                        bits |= {"r": 4, "w": 2, "x": 1}[c] << shift[w]
                    elif c == "X" and (directory or mode & 0o111):
                        bits |= 1 << shift[w]
                    elif c == "s":
                        bits |= {"u": 0o4000, "g": 0o2000, "o": 0}[w]
                    elif c == "t":
                        bits |= 0o1000
                    elif c in "ugo":
                        bits |= (mode >> shift[c] & 7) << shift[w]
            if op == "+":
                mode |= bits
            elif op == "-":
                mode &= ~bits
            else:
                for w in who:
                    mode &= ~(7 << shift[w])
                mode |= bits
    return mode


def octal(mode: Column, prefix: bool = False) -> Column:
    text = F.conv(mode.bitwiseAND(F.lit(0o7777)).cast("string"), 10, 8)
    return F.concat(F.lit("0"), text) if prefix else text


def letters(mode: Column, kind: Column) -> Column:
    """-rwxr-xr-x with s, S, t and T."""
    first = kind_letter(kind)
    first = F.when(first == "f", "-").otherwise(first)
    on = lambda bit: mode.bitwiseAND(F.lit(bit)) != 0
    out = [first]
    for r, w, x, special, low, high in ((0o400, 0o200, 0o100, 0o4000, "s", "S"), (0o40, 0o20, 0o10, 0o2000, "s", "S"), (4, 2, 1, 0o1000, "t", "T")):
        out += [F.when(on(r), "r").otherwise("-"), F.when(on(w), "w").otherwise("-")]
        out.append(F.when(on(special) & on(x), low).when(on(special), high).when(on(x), "x").otherwise("-"))
    return F.concat(*out)


def kind_letter(kind: Column) -> Column:
    out = F.lit("U")
    for name, letter in (("file", "f"), ("dir", "d"), ("symlink", "l"), ("fifo", "p"), ("socket", "s"), ("block", "b"), ("character", "c")):
        out = F.when(kind == name, letter).otherwise(out)
    return out


def major(dev: Column) -> Column:
    return F.shiftright(dev, 8).bitwiseAND(F.lit(0xFFF)).bitwiseOR(F.shiftright(dev, 32).bitwiseAND(F.lit(-4096)))


def minor(dev: Column) -> Column:
    return dev.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftright(dev, 12).bitwiseAND(F.lit(0xFFFFFF00)))


def makedev(high: int, low: int) -> int:
    return (high & 0xFFF) << 8 | (high & ~0xFFF) << 32 | low & 0xFF | (low & ~0xFF) << 12
