"""Rooted trees in Newick form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Tree:
    parent: dict[str, str | None] = field(default_factory=dict)
    length: dict[str, float | None] = field(default_factory=dict)
    leaves: list[str] = field(default_factory=list)


def parse(text: str) -> Tree:
    """Quoted labels, comments in brackets, optional lengths of zero or more; labels must be unique; unnamed inner nodes get ``_n``."""
    tokens = re.findall(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),:;]|[^\s(),:;\[\]']+", text)
    tokens = [t for t in tokens if not t.startswith("[")]
    tree, at, unnamed = Tree(), 0, 0

    def fail(what: str):
        raise ValueError(f"Newick: {what} at token {at}")

    def node() -> str:
        nonlocal at, unnamed
        children = []
        if at < len(tokens) and tokens[at] == "(":
            while True:
                at += 1
                children.append(node())
                if at >= len(tokens) or tokens[at] not in ",)":
                    fail("expected , or )")
                if tokens[at] == ")":
                    at += 1
                    break
        name = None
        if at < len(tokens) and tokens[at] not in "(),:;":
            raw = tokens[at]
            name = raw[1:-1].replace("''", "'") if raw.startswith("'") else raw
            at += 1
        if name is None:
            if not children:
                fail("a leaf without a label")
            name, unnamed = f"_{unnamed}", unnamed + 1
        length = None
        if at < len(tokens) and tokens[at] == ":":
            length = float(tokens[at + 1])
            at += 2
            if not length >= 0:
                fail("a negative length")
        if name in tree.parent:
            fail(f"label {name} twice")
        tree.parent[name], tree.length[name] = None, length
        for c in children:
            tree.parent[c] = name
        if not children:
            tree.leaves.append(name)
        return name

    node()
    if at >= len(tokens) or tokens[at] != ";" or at + 1 != len(tokens):
        fail("expected one ; at the end")
    return tree
