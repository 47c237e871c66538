"""Regular expressions and date formats as Python users write them, turned into Java's."""

from __future__ import annotations

import re

# Strftime codes and Java date letters.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%A": "EEEE", "%a": "EEE", "%B": "MMMM", "%b": "MMM", "%Z": "zzz", "%%": "%",
    "%z": "xx", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%D": "MM/dd/yy", "%e": "d",
}


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect, Unicode-aware as Python's; ValueError for what Java lacks or Python refuses."""
    re.compile(pattern)
    names: list[str] = []

    def named(m: re.Match) -> str:
        java = re.sub("[^A-Za-z0-9]", "", m[1]) or "g"
        java = java if java[0].isalpha() else "g" + java
        names.append(m[1])
        return f"(?<{java}>"

    if re.search(r"\(\?\((\w+)\)", pattern):
        raise ValueError("conditional groups are not supported")
    out = re.sub(r"\(\?P<(\w+)>", named, pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{re.sub('[^A-Za-z0-9]', '', m[1])}>", out)
    out = out.replace(r"\Z", r"\z")
    return "(?U)" + out


def java_replacement(replacement: str, pattern: str) -> str:
    """A Python replacement (\\1, \\g<1>, \\g<name>) in Java's dialect, with $ taken literally."""
    groups = re.compile(pattern).groupindex
    out, i = "", 0
    while i < len(replacement):
        c = replacement[i]
        if c == "\\" and i + 1 < len(replacement):
            if m := re.match(r"\\g<(\w+)>", replacement[i:]):
                n = int(m[1]) if m[1].isdigit() else groups[m[1]]
                out, i = out + f"${n}", i + m.end()
                nxt = replacement[i : i + 1]
                out += "\\" + nxt if nxt.isdigit() else ""
                i += 1 if nxt.isdigit() else 0
                continue
            if m := re.match(r"\\(\d{1,2})", replacement[i:]):
                out, i = out + f"${int(m[1])}", i + m.end()
                continue
            out += {"n": "\n", "t": "\t", "r": "\r"}.get(replacement[i + 1], "\\" + replacement[i + 1])
            i += 2
            continue
        out += "\\$" if c == "$" else c
        i += 1
    return out


def literal(text: str) -> str:
    """A pattern that matches exactly `text`."""
    return "".join("\\" + c if not (c.isalnum() or c == "_" or c.isspace() or ord(c) > 127) else c for c in text)


def java_date_format(fmt: str) -> str:
    """A strftime format as a Java pattern; a format without % is taken as Java's already."""
    if "%" not in fmt:
        return fmt
    out, text, i = "", "", 0

    def flush() -> str:
        return ("'" + text.replace("'", "''") + "'" if any(c.isalpha() for c in text) else text.replace("'", "''")) if text else ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            code = fmt[i : i + 2]
            if code not in STRFTIME:
                raise ValueError(f"Unknown date code {code!r}")
            if code == "%%":
                text += "%"
            else:
                out, text = out + flush() + STRFTIME[code], ""
            i += 2
        else:
            text += fmt[i]
            i += 1
    return out + flush()
