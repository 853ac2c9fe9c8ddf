"""Tip order of Newick trees, by which genomes are arranged; a tree has a tip a genome, so it is parsed on the driver."""

from __future__ import annotations

import re


def tips(tree: str, ladderize: bool = True) -> list[str]:
    """Names of the tips from first to last; with ``ladderize`` smaller clades come first."""
    tokens = re.findall(r"\(|\)|,|;|'(?:[^']|'')*'|[^(),;]+", tree)
    stack: list[list] = [[]]
    for t in tokens:
        if t == "(":
            stack.append([])
        elif t == ")":
            done = stack.pop()
            stack[-1].append(done)
        elif t not in ",;" and t.strip():
            name = t.strip().split(":")[0].strip("'")
            closes = stack[-1] and isinstance(stack[-1][-1], list) and not getattr(stack[-1][-1], "named", False)
            if name and not (closes and tokens[tokens.index(t) - 1] == ")"):
                stack[-1].append(name)

    def walk(node: list | str) -> list[str]:
        if isinstance(node, str):
            return [node]
        parts = [walk(x) for x in node]
        if ladderize:
            parts.sort(key=len)
        return [x for p in parts for x in p]

    return walk(stack[0])


def order(tree: str | None, genomes: list[str]) -> list[str]:
    """Genomes in the order of the tree, in the given order if the tree is missing or names others."""
    try:
        found = [t for t in tips(tree or "") if t in genomes]
    except (IndexError, ValueError):
        return genomes
    return found if sorted(found) == sorted(genomes) else genomes
