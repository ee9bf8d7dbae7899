"""The query language: `y | y2 ~ covariates | factors | (endogenous ~ instruments) | clusters | controls`."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Model:
    lhs: list[str]
    covariates: list[str]
    factors: list[str]
    endogenous: list[str] = field(default_factory=list)
    instruments: list[str] = field(default_factory=list)
    clusters: list[str] = field(default_factory=list)
    controls: list[str] = field(default_factory=list)
    #: None: there is one unless a pure factor is absorbed
    intercept: bool | None = None

    def text(self) -> str:
        plus = lambda x: " + ".join(x) or "0"
        first = plus(self.covariates) if self.intercept is not False else " + ".join([*self.covariates, "0"])
        iv = f"({' | '.join(self.endogenous)} ~ {plus(self.instruments)})" if self.endogenous else "0"
        return f"{' | '.join(self.lhs)} ~ {first} | {plus(self.factors)} | {iv} | {plus(self.clusters)} | {plus(self.controls)}"


def split(text: str, signs: str) -> list[tuple[str, str]]:
    """(sign, piece) at the top level of parentheses and backquotes; the first sign may be empty."""
    out, sign, piece, depth, quoted = [], "", "", 0, False
    for c in text:
        quoted ^= c == "`"
        depth += (c == "(") - (c == ")")
        if c in signs and not depth and not quoted:
            out.append((sign, piece.strip()))
            sign, piece = c, ""
        else:
            piece += c
    out.append((sign, piece.strip()))
    return out


def terms(text: str) -> tuple[list[str], bool | None]:
    """Terms of a sum, a * b expanded, and what is said about the intercept."""
    out, intercept = [], None
    for sign, t in split(text, "+-"):
        if t in ("", "0", "1"):
            if t:
                intercept = (t == "1") != (sign == "-")
            continue
        parts = [p for _, p in split(t, "*")] if not re.fullmatch(r"\w+\(.*\)", t) else [t]
        each = [*parts, ":".join(parts)] if len(parts) == 2 else parts
        for e in each:
            if sign == "-":
                out = [x for x in out if x != e]
            elif e not in out:
                out.append(e)
    return out, intercept


def wild(text: str, columns: list[str], mode: str) -> str:
    """Names with * ? (glob, mode 'g') or patterns in backquotes (mode 'r'), replaced by sums of the columns that they match."""
    if mode == "n":
        return text

    def one(t: str) -> str:
        bare = t.strip("`")
        if mode.lower() == "g" and re.search(r"[*?\[]", bare) and not re.search(r"[():]", bare):
            found = [c for c in columns if fnmatch.fnmatchcase(c, bare)]
        elif mode.lower() == "r" and t.startswith("`"):
            found = [c for c in columns if re.fullmatch(bare, c)]
        else:
            return t
        return " + ".join(found) or "0"

    parts = [" + ".join(one(t) if s != "-" else f"-{t}" for s, t in split(p, "+-")) for _, p in split(text, "|~")]
    seps = [s for s, _ in split(text, "|~")]
    return "".join(f" {s} {p}" if s else p for s, p in zip(seps, parts, strict=True))


def _legacy(text: str) -> str:
    """G(f) terms of the old syntax become the second part."""
    if not re.search(r"\bG\(", text):
        return text
    lhs, rhs = text.split("~", 1)
    parts = [p for _, p in split(rhs, "|")]
    kept, groups = [], []
    for sign, t in split(parts[0], "+-"):
        m = re.fullmatch(r"G\((.*)\)", t)
        (groups if m else kept).append(m[1] if m else f"{sign}{t}" if sign == "-" else t)
    second = [x for x in parts[1:2] if x not in ("", "0")]
    return f"{lhs}~ {' + '.join(kept) or '0'} | {' + '.join([*second, *groups])}" + "".join(f" | {p}" for p in parts[2:])


def parse(text: str, columns: list[str] | None = None, wildcard: str = "n", iv: str | list[str] | None = None, clustervar: str | list[str] | None = None) -> Model:
    """iv and clustervar are the old arguments: formulas `Q ~ z`, and names."""
    text = _legacy(text)
    if text.count("~") < 1:
        raise ValueError("a formula needs a ~")
    at = text.index("~")
    left, right = text[:at], text[at + 1 :]
    if columns is not None:
        left, right = wild(left, columns, wildcard), wild(right, columns, wildcard)
    parts = [p for _, p in split(right, "|")]
    if len(parts) > 5:
        raise ValueError("a formula has five parts at most")
    parts += ["0"] * (5 - len(parts))
    lhs = [x for _, p in split(left, "|") for x in terms(p)[0]]
    covariates, said = terms(parts[0])
    factors = terms(parts[1])[0]
    endogenous, instruments = [], []
    forms = [parts[2].strip()[1:-1]] if parts[2].strip().startswith("(") else []
    if not forms and parts[2].strip() not in ("", "0"):
        raise ValueError("the third part is (endogenous ~ instruments) or 0")
    for f in forms + ([iv] if isinstance(iv, str) else iv or []):
        if f.count("~") != 1:
            raise ValueError("instruments have one part")
        a, b = f.split("~")
        endogenous += [x for _, p in split(a, "|") for x in terms(p)[0]]
        instruments += [x for x in terms(b)[0] if x not in instruments]
    clusters = terms(parts[3])[0] + ([clustervar] if isinstance(clustervar, str) else clustervar or [])
    return Model(lhs, covariates, factors, endogenous, instruments, clusters, terms(parts[4])[0], said)


def updated(model: Model, change: str) -> Model:
    """The model with a formula applied in which . stands for the part as it was."""
    at = change.index("~")
    old = [p for _, p in split(model.text().split("~", 1)[1], "|")]
    new = [p for _, p in split(change[at + 1 :], "|")]
    dot = lambda t, p: re.sub(r"(?<![\w.])\.(?![\w.])", lambda _: p, t)
    rhs = " | ".join([dot(t, old[k]) for k, t in enumerate(new)] + old[len(new) :])
    lhs = change[:at].strip()
    out = parse(f"{dot(lhs, ' | '.join(model.lhs))} ~ {rhs}")
    return replace(out)
