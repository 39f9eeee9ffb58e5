"""A small in-memory model of threading, written for tests: slow, direct, and apart from the engine."""

from __future__ import annotations

import re
from email.utils import parsedate_to_datetime

EARLIEST = -62_135_596_800_000_000


def micros_of(date):
    """Microseconds of a date that has no fault."""
    return None if date is None else int(parsedate_to_datetime(date).timestamp()) * 1_000_000


def base_subject_of(subject):
    """(base, whether a reply) of subjects with leaders and list tags alone."""
    text, reply = (subject or "").strip(), False
    while True:
        if lead := re.match(r"(\[\w+\] ?)*(re|fwd?):\s*", text, re.I):
            text, reply = text[lead.end() :], True
        elif tag := re.match(r"\[\w+\] ?(?=.)", text):
            text = text[tag.end() :]
        else:
            return text, reply


casemap = str.upper  # of ASCII


class Box:
    def __init__(self, message=None):
        self.message, self.up, self.down = message, None, []

    def above(self):
        node = self
        while node:
            yield node
            node = node.up

    def take(self, child):
        if child.up:
            child.up.down.remove(child)
        child.up = self
        self.down.append(child)


def ids(header):
    import re

    out = []
    for part in header or []:
        found = re.findall("<([^>]+)>", part) or part.split()
        for x in found:
            x = x.strip().strip("<>").strip()
            if x and x not in out:
                out.append(x)
    return out


def thread(messages, by_subject=False, by_date=False):
    """messages: dicts in order of input_pos. Returns the roots."""
    table, made, keys = {}, [], {}

    def new(message=None):
        made.append(Box(message))
        return made[-1]

    for m in messages:
        own = ids(["<" + m["message_id"] + ">"])[:1] if m.get("message_id") else []
        name = own[0] if own else None
        if name is not None and name in table and table[name].message is None:
            box = table[name]
            box.message = m
        else:
            box = new(m)
            if name is not None:
                table.setdefault(name, box)
        sent = micros_of(m.get("sent_date"))
        sent = micros_of(m.get("internal_date")) if sent is None else sent
        keys[id(box)] = (EARLIEST if sent is None else sent, m.get("sequence_number") or m["input_pos"], m["input_pos"])
        refs = ids(m.get("references")) or ids(m.get("in_reply_to"))[:1]
        chain = []
        for r in refs:
            if r not in table:
                table[r] = new()
            chain.append(table[r])
        for a, b in zip(chain, chain[1:]):
            if not b.up and b not in a.above():
                a.take(b)
        if chain and chain[-1] is not box and box not in chain[-1].above():
            chain[-1].take(box)


    def flat_tree(node):
        kept = [y for x in node.down for y in flat_tree(x)]
        if not node.message:
            return kept
        node.down = kept
        for k in kept:
            k.up = node
        return [node]

    roots = []
    for r in [b for b in made if not b.up]:
        kept = flat_tree(r)
        if r.message or len(kept) < 2:
            for k in kept:
                k.up = None
            roots += kept
        else:
            r.down = kept
            for k in kept:
                k.up = r
            roots.append(r)

    def key(node):
        return keys[id(node)] if node.message else key(node.down[0])

    if by_date:
        for r in roots:
            if not r.message:
                r.down.sort(key=key)
        roots.sort(key=key)
    if by_subject:
        roots = grouped(roots)
    if by_date:

        def sort(node):
            for x in node.down:
                sort(x)
            node.down.sort(key=key)

        for r in roots:
            sort(r)
        roots.sort(key=key)
    return roots


def grouped(roots):
    def subject(node):
        return base_subject_of((node if node.message else node.down[0]).message.get("subject"))

    groups = {}
    for r in roots:
        base, reply = subject(r)
        if k := casemap(base):
            groups.setdefault(k, []).append((r, reply))
    place = {id(r): i for i, r in enumerate(roots)}
    gone, made = set(), []
    for members in groups.values():
        if len(members) < 2:
            continue
        dummies = [r for r, _ in members if not r.message]
        fresh = [r for r, reply in members if r.message and not reply]
        owner = (dummies or fresh or [members[0][0]])[0]
        first = min(place[id(r)] for r, _ in members)
        for r, reply in members:
            if r is owner:
                continue
            gone.add(id(r))
            if not owner.message:
                for c in list(r.down) if not r.message else [r]:
                    owner.take(c)
            elif fresh and reply:
                owner.take(r)
            else:
                both = Box()
                gone.add(id(owner))
                both.take(owner)
                both.take(r)
                made.append(both)
                owner = both
        place[id(owner)] = first
    return sorted([r for r in [*roots, *made] if id(r) not in gone], key=lambda r: place[id(r)])


def shape(node):
    """A tree as (position or None, children)."""
    return (node.message["input_pos"] if node.message else None, [shape(c) for c in node.down])


def table_shape(rows):
    """The same from a forest table."""
    below = {}
    for r in sorted(rows, key=lambda r: r["sibling_ord"]):
        below.setdefault(r["parent_id"], []).append(r)
    tops = sorted(below.get(None, []), key=lambda r: r["root_ord"])

    def of(r):
        return (r["input_pos"], [of(c) for c in below.get(r["node_id"], [])])

    return [of(r) for r in tops]
