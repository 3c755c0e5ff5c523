"""The nodes of source files from their tokens, for many files at a time in numpy.

Every step is a window over sorted rows: running sums, the last opened bracket of a level,
sums over the stretches between separators. Files are one after the other in all arrays, and
a sort key begins with the number of the file, so no window reaches into the next one.

The tokens of a file have their place in it, ``seq``. Texts that share a document id are read
as one file in which equal places lie side by side; sorts are stable then, and begin from the
order the sort before has left.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Fixed values of the language: words and signs by what they do.
CLASS_WORDS = ("class", "interface", "enum")
NEVER_CALLED = ("if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "assert", "case", "do", "try")
BEFORE_EXPRESSIONS = (*NEVER_CALLED, "new", "else", "instanceof", "extends", "implements", "throws", "import", "package")
LITERAL_WORDS = ("true", "false", "null")
BINARY = ("+", "-", "*", "/", "%", "<", ">", "<=", ">=", "==", "!=", "&&", "||", "&", "|", "^", "<<", ">>")
ASSIGNING = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")
CUTTING_OPERATORS = ("-", "/", "%")
OPENING, CLOSING = ("(", "[", "{"), (")", "]", "}")
#: What may follow a closing brace inside the same statement.
GOES_ON = (";", ",", ")", ".")

ROOT = "CompilationUnit"
#: Node types by the number that stands for them.
KINDS = (
    ROOT,
    "Statement",
    "Assignment",
    "VariableDeclaration",
    "MethodDeclaration",
    "WhileStatement",
    "ForStatement",
    "IfStatement",
    "ClassDeclaration",
    "FunctionCall",
    "BinaryOperation",
    "Literal",
    "Parameter",
)
_KIND = {name: number for number, name in enumerate(KINDS)}

#: Tokens handled at a time. A file with more is handled alone.
SLICE_TOKENS = 1 << 18

_DIGITS_AND_QUOTES = frozenset("0123456789\"'")
_NO_WORD = _DIGITS_AND_QUOTES | frozenset("/&|+-<>:*%^=!~?;,.(){}[]@\n")

# What a token is, as bits of a number.
(
    _WORD, _NEVER, _TYPES, _OPERAND, _LITERAL, _UPPER, _ARGUMENT, _ENDS_ARGUMENT, _BINARY, _ASSIGNS, _CUTS,
    _CLASS, _OPENS, _CLOSES, _GOES_ON, _AFTER_VARIABLE, _AFTER_PARAMETER, _COMMENT, _NEWLINE,
) = (1 << i for i in range(19))
_ID_AT = 19

# Tokens that are asked for by themselves.
_NAMED = ("(", "[", "{", ")", "]", "}", "<", ">", ";", ",", "if", "else", "for", "while")
_ID = {token: number for number, token in enumerate(_NAMED, 1)}


@lru_cache(1 << 16)
def _bits(token: str) -> int:
    """What a token is; above the bits its number among those asked for by themselves."""
    start = token[0]
    if token == "\n":
        return _NEWLINE
    if token.startswith(("//", "/*")):
        return _COMMENT
    found = 0
    quoted, word = start in _DIGITS_AND_QUOTES, start not in _NO_WORD
    ends_type = (word and token not in BEFORE_EXPRESSIONS) or token in ("]", ">")
    upper = unicodedata.category(start) == "Lu"
    for bit, holds in (
        (_WORD, word),
        (_NEVER, token in NEVER_CALLED),
        (_TYPES, ends_type),
        (_OPERAND, (word and token not in BEFORE_EXPRESSIONS) or quoted or token in (")", "]")),
        (_LITERAL, quoted or token in LITERAL_WORDS),
        (_UPPER, upper),
        (_ARGUMENT, upper or start in ">?"),
        (_ENDS_ARGUMENT, upper or token in (">", "]", "?")),
        (_BINARY, token in BINARY),
        (_ASSIGNS, token in ASSIGNING),
        (_CUTS, token in CUTTING_OPERATORS),
        (_CLASS, token in CLASS_WORDS),
        (_OPENS, token in OPENING),
        (_CLOSES, token in CLOSING),
        (_GOES_ON, token in GOES_ON),
        (_AFTER_VARIABLE, token in ("=", ";", ",", ":")),
        (_AFTER_PARAMETER, token in (",", ")")),
    ):
        if holds:
            found |= bit
    return found | _ID.get(token, 0) << _ID_AT


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in a key."""
    out = np.empty(len(keys[0]), bool)
    out[:1] = True
    out[1:] = keys[0][1:] != keys[0][:-1]
    for key in keys[1:]:
        out[1:] |= key[1:] != key[:-1]
    return out


def _running(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Running sums that start anew where ``begins``."""
    sums = np.cumsum(values, dtype=np.int64)
    starts = np.flatnonzero(begins)
    before = np.zeros(len(starts), np.int64)
    before[1:] = sums[starts[1:] - 1]
    return sums - np.repeat(before, np.diff(starts, append=len(values)))


def _last(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Place of the last row with a flag up to each row, since ``begins``; -1 if there is none."""
    places = np.arange(len(flags))
    found = np.maximum.accumulate(np.where(flags, places, -1))
    return np.where(found >= np.maximum.accumulate(np.where(begins, places, 0)), found, -1)


def _shifted(values: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` rows earlier in the file, or later if below 0; 0 where there is none."""
    out = np.zeros_like(values)
    if by > 0:
        out[by:] = np.where(doc[by:] == doc[:-by], values[:-by], 0)
    else:
        out[:by] = np.where(doc[:by] == doc[-by:], values[-by:], 0)
    return out


def _by(key: np.ndarray, fine: np.ndarray, physical: np.ndarray | None) -> np.ndarray:
    """Rows by key and ``fine``; without a ``physical`` order they lie by ``fine`` already."""
    if physical is None:
        return np.argsort(key, kind="stable")
    return physical[np.lexsort((fine[physical], key[physical]))]


class _Tokens:
    """The tokens of some files without comments, in order, and what each one is."""

    def __init__(self, found: pa.Array, text: np.ndarray, doc_of_text: np.ndarray):
        encoded = found.dictionary_encode()
        words = encoded.dictionary.to_pylist()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bits = np.fromiter(map(_bits, words), np.int64, len(words))
        breaks = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(bits & _COMMENT):
            breaks[i] = words[i].count("\n")

        newline = (bits[code] & _NEWLINE) != 0
        passed = _running(newline, _begins(text))
        code, text, passed = code[~newline], text[~newline], passed[~newline]
        before = passed - _shifted(passed, text, 1)
        seq = _running(np.ones(len(code), np.int64), _begins(text)) - 1
        doc = doc_of_text[text]
        #: Whether texts share a file, so that places in it come twice.
        self.twice = len(np.unique(doc_of_text)) < len(doc_of_text)
        if self.twice:
            order = np.lexsort((seq, doc))
            code, before, seq, doc = code[order], before[order], seq[order], doc[order]
        own = breaks[code]
        line = 1 + _running(before + own, _begins(doc)) - own

        kept = (bits[code] & _COMMENT) == 0
        self.code, self.seq, self.doc, self.line = code[kept], seq[kept], doc[kept], line[kept]
        self.bits = bits[self.code]
        ids = bits >> _ID_AT
        self.id = self.bits >> _ID_AT
        # Among texts of one file the least token of a place is its first.
        self.rank, self.by_rank = self.code, ids
        if self.twice:
            least = sorted(range(len(words)), key=lambda i: words[i].encode())
            rank = np.empty(len(words), np.int64)
            rank[least] = np.arange(len(words))
            self.rank, self.by_rank = rank[self.code], ids[least]

    def has(self, bit: int) -> np.ndarray:
        return (self.bits & bit) != 0

    def near(self, by: int) -> np.ndarray:
        return _shifted(self.bits, self.doc, by)


def _described(t: _Tokens) -> None:
    """Say of each token what it is by its neighbours, and the depth of brackets after it."""
    last, last2, following = t.near(1), t.near(2), t.near(-1)
    following_id = _shifted(t.id, t.doc, -1)
    after_type, word = (last & _TYPES) != 0, t.has(_WORD)
    opens_call = (t.id == _ID["("]) & ((last & _WORD) != 0) & ((last & _NEVER) == 0)
    t.is_header = opens_call & ((last2 & _TYPES) != 0)
    t.is_call = opens_call & ~t.is_header
    t.is_literal = t.has(_LITERAL)
    type_argument = ((t.id == _ID["<"]) & ((following & _ARGUMENT) != 0)) | (
        (t.id == _ID[">"]) & ((last & _ENDS_ARGUMENT) != 0)
    )
    t.is_operator = t.has(_BINARY) & ((last & _OPERAND) != 0) & ~type_argument
    t.is_variable = word & after_type & ((following & _AFTER_VARIABLE) != 0)
    t.names_parameter = word & after_type & ((following & _AFTER_PARAMETER) != 0)
    # A called name is a node where its bracket is the next token.
    t.is_called = (following_id == _ID["("]) & word & ~t.has(_NEVER) & ~after_type
    t.goes_on = (following & _GOES_ON) != 0
    first = _begins(t.doc)
    t.is_last = np.append(first[1:], True)[: len(first)]
    t.after = _running(t.has(_OPENS).astype(np.int64) - t.has(_CLOSES), first)


MEMBER, OPEN, CLOSE = 0, 1, 2


class _Rows:
    """Rows per level: ``home`` is the bracket a token lies in.

    A bracket is a member of the level outside and an edge of the level inside. Rows of
    files whose brackets do not match are left out.
    """

    def __init__(self, t: _Tokens):
        opens, closes = t.has(_OPENS), t.has(_CLOSES)
        token = np.repeat(np.arange(len(t.id)), 1 + (opens | closes))
        second = ~_begins(token)
        opens, closes = opens[token], closes[token]
        edge = np.where(opens & second, OPEN, np.where(closes & ~second, CLOSE, MEMBER))
        self.part = np.where(edge == OPEN, 2, np.where(edge == CLOSE, 0, 1))
        after = t.after[token]
        level = after - (opens & ~second) + (edge == CLOSE)
        self.doc, self.seq = t.doc[token], t.seq[token]
        fine = self.seq * 3 + self.part

        low = level.min(initial=0)
        key = self.doc * (level.max(initial=0) - low + 1) + level - low
        natural = np.arange(len(token)) if t.twice else None
        if t.twice:
            natural = np.lexsort((fine, self.doc))
        order = _by(key, fine, natural)
        last = _last(edge[order] == OPEN, _begins(key[order]))
        home = np.empty(len(token), np.int64)
        home[order] = np.where(last >= 0, token[order[last]], -1)

        partner = t.id[home] + _ID[")"] - _ID["("]
        wrong = (edge == CLOSE) & ~((home >= 0) & (partner == t.id[token]))
        bad = np.zeros(self.doc.max(initial=-1) + 1, bool)
        bad[self.doc[(after < 0) | wrong | (t.is_last[token] & (after != 0))]] = True

        kept = ~bad[self.doc]
        self.token, self.edge, self.home, self.fine = token[kept], edge[kept], home[kept], fine[kept]
        self.doc, self.seq, self.part = self.doc[kept], self.seq[kept], self.part[kept]
        self.physical = None
        if t.twice:
            new = np.cumsum(kept) - 1
            self.physical = new[order[kept[order]]]


def _statements(t: _Tokens, r: _Rows) -> None:
    """Number the statements and the stretches between separators inside every bracket, and type the statements."""
    token, member, token_id = r.token, r.edge == MEMBER, t.id[r.token]
    in_block = (r.home < 0) | (t.id[r.home] == _ID["{"])
    block_end = (token_id == _ID["}"]) & ~t.goes_on[token]
    ends = member & in_block & ((token_id == _ID[";"]) | block_end)
    separates = ends | (member & ((token_id == _ID[","]) | (token_id == _ID[";"]))) | (r.edge == CLOSE)
    home_seq = np.where(r.home >= 0, t.seq[r.home], -1)
    key = r.doc * (t.seq.max(initial=0) + 2) + home_seq + 1
    order = _by(key, r.fine, r.physical)
    if r.physical is not None:
        r.physical = order
    begins = _begins(key[order])

    def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rows of the runs that end with a flag, in order, and the run of every row."""
        new = begins.copy()
        new[1:] |= flags[order][:-1]
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(new) - 1
        return np.flatnonzero(new), run

    starts, statement = runs(ends)
    own = member & in_block & (token_id != _ID[";"])
    none = np.iinfo(np.int64).max
    many = len(t.by_rank) + 1
    first = np.minimum.reduceat(np.where(own, r.seq * many + t.rank[token], none)[order], starts)
    r.has_first = (first != none)[statement]
    r.first_seq = (first // many)[statement]
    started = t.by_rank[np.where(first != none, first % many, 0)]
    holds = (
        (t.bits[token] & _CLASS != 0) * 1
        + (token_id == _ID["if"]) * 2
        + t.is_header[token] * 4
        + t.is_variable[token] * 8
        + t.has(_ASSIGNS)[token] * 16
    )
    held = np.bitwise_or.reduceat(np.where(own, holds, 0)[order], starts)
    kinds = np.select(
        [
            held & 1 != 0,
            (started == _ID["if"]) | ((started == _ID["else"]) & (held & 2 != 0)),
            started == _ID["for"],
            started == _ID["while"],
            held & 4 != 0,
            held & 8 != 0,
            held & 16 != 0,
        ],
        [_KIND[name] for name in (
            "ClassDeclaration", "IfStatement", "ForStatement", "WhileStatement",
            "MethodDeclaration", "VariableDeclaration", "Assignment",
        )],
        _KIND["Statement"],
    )
    r.statement_kind = kinds[statement]
    starts, stretch = runs(separates)
    r.operators = np.add.reduceat((member & t.is_operator[token]).astype(np.int64)[order], starts)[stretch]
    r.member, r.in_block, r.ends, r.separates = member, in_block, ends, separates


def tree(found: pa.Array, text: np.ndarray, doc_of_text: np.ndarray) -> dict[str, np.ndarray]:
    """``doc, depth, kind, line, is_cut`` of the nodes in preorder.

    ``found`` are the tokens of all texts, line ends among them, ``text`` says of which text each
    one is, and ``doc_of_text`` of which file a text is; both only grow.
    """
    nothing = np.empty(0, np.int64)
    empty = {"doc": nothing, "depth": nothing, "kind": nothing, "line": nothing, "is_cut": nothing.astype(bool)}
    t = _Tokens(found, text, doc_of_text)
    if not len(t.id):
        return empty
    _described(t)
    r = _Rows(t)
    if not len(r.token):
        return empty
    _statements(t, r)
    token, has_home = r.token, r.home >= 0
    opens_statement = r.member & r.has_first & (r.first_seq == r.seq)
    closes_statement = r.has_first & (r.ends | ((r.edge == CLOSE) & r.in_block))
    is_called, is_operator = t.is_called[token], t.is_operator[token]
    opens_run = r.member & (is_called | is_operator)
    closes_call = (r.edge == CLOSE) & has_home & t.is_call[r.home]
    is_parameter = t.names_parameter[token] & has_home & t.is_header[r.home]
    kind = np.select(
        [~r.member, is_called, is_operator, t.is_literal[token], is_parameter],
        [-1, _KIND["FunctionCall"], _KIND["BinaryOperation"], _KIND["Literal"], _KIND["Parameter"]],
        -1,
    )
    step = opens_statement.astype(np.int64) + opens_run - closes_statement - closes_call
    step -= np.where(r.separates, r.operators, 0)

    order = np.arange(len(token)) if r.physical is None else _by(r.doc, r.fine, r.physical)
    doc, step, opens_statement, kind = r.doc[order], step[order], opens_statement[order], kind[order]
    is_first = _begins(doc)
    depth = 1 + _running(step, is_first) - step
    cuts = (is_operator & t.has(_CUTS)[token])[order]
    zero = np.zeros_like(depth)
    # Up to three nodes of a row, side by side.
    wanted = np.stack([is_first, opens_statement, kind >= 0], 1)
    fields = {
        "depth": np.stack([zero, depth, depth + opens_statement], 1),
        "kind": np.stack([zero + _KIND[ROOT], r.statement_kind[order], kind], 1),
        "is_cut": np.stack([zero > 0, zero > 0, cuts], 1),
    }
    row, _ = np.nonzero(wanted)
    nodes = {name: values[wanted] for name, values in fields.items()}
    nodes |= {"doc": doc[row], "line": t.line[token[order[row]]]}
    if r.physical is not None:
        nth = (np.cumsum(wanted, 1) - 1)[wanted]
        order = np.lexsort((nth, r.fine[order[row]], nodes["doc"]))
        nodes = {name: values[order] for name, values in nodes.items()}
    return nodes


def hashed(nodes: dict[str, np.ndarray], base_of_kind: np.ndarray) -> dict[str, np.ndarray]:
    """``doc, position, kind, depth, children, hash, line`` of the nodes of ``tree``; see ``trees.subtree_hashes``.

    A row per close event; ``position`` is -1 where nothing was open, and all that follows void.
    """
    doc, depth, is_cut = nodes["doc"], nodes["depth"], nodes["is_cut"]
    n = len(doc)
    base = base_of_kind[nodes["kind"]]
    begins = _begins(doc)
    starts = np.flatnonzero(begins)
    # The least depth so far: files are set apart by more than any depth.
    apart = depth - np.cumsum(begins) * (depth.max(initial=0) - depth.min(initial=0) + 1)
    top = np.minimum.accumulate(apart) - apart + depth
    is_last = np.append(begins[1:], True)[:n]
    last_closed = np.maximum(np.where(is_last, top, np.append(depth[1:], 0)[:n]), top)
    closing = np.maximum(depth - last_closed + 1, 0)

    node = np.repeat(np.arange(n), 2 + closing)
    part = _running(np.ones(len(node), np.int64), _begins(node)) - 1
    level = np.where(part < 2, depth[node] - 1 + part, depth[node] - part + 2)
    is_open, is_close = part == 1, part >= 2
    span = level.max(initial=0) - level.min(initial=0) + 1
    key = doc[node] * span + level - level.min(initial=0)
    order = np.argsort(key, kind="stable")
    new = _begins(key[order])
    children, opened = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
    children[order] = _running(part[order] == 0, new)
    last = _last(is_open[order], new)
    opened[order] = np.where(last >= 0, order[last], -1)

    # Nodes inside a cut do not count for those outside: sums are taken by the number of enclosing cuts.
    of = np.where(opened >= 0, node[opened], -1)
    cut_of = (of >= 0) & is_cut[of]
    in_cut = is_open & is_cut[node]
    cuts = _running(in_cut.astype(np.int64) - (is_close & cut_of), _begins(doc[node])) - in_cut
    key = doc[node] * (cuts.max(initial=0) - cuts.min(initial=0) + 1) + cuts - cuts.min(initial=0)
    order = np.argsort(key, kind="stable")
    total = np.empty(len(node), np.int64)
    total[order] = _running(np.where(is_open, base[node], 0)[order], _begins(key[order]))

    at = np.flatnonzero(is_close)
    begun, of, lost = opened[at], of[at], opened[at] < 0
    value = np.where(is_cut[of], base[of], total[at] - total[begun] + base[of])
    return {
        "doc": doc[node[at]],
        "position": np.where(lost, -1, of - starts[np.cumsum(begins) - 1][of]),
        "kind": nodes["kind"][of],
        "depth": depth[of],
        "children": children[at] - children[begun],
        "hash": value,
        "line": nodes["line"][of],
    }


def slices(tokens: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """``(first file, last file + 1, found, text, doc_of_text)`` of files ``list<list<string>>``, some at a time."""
    files = tokens.offsets.to_numpy().astype(np.int64)
    texts = tokens.values.offsets.to_numpy().astype(np.int64)
    found, ends, lo = tokens.values.values, texts[files], 0
    while lo < len(tokens):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_TOKENS, side="right")) - 1)
        lengths = np.diff(texts[files[lo] : files[hi] + 1])
        text = np.repeat(np.arange(len(lengths)), lengths)
        doc_of_text = np.repeat(np.arange(hi - lo), np.diff(files[lo : hi + 1]))
        yield lo, hi, found.slice(ends[lo], ends[hi] - ends[lo]), text, doc_of_text
        lo = hi


def as_lists(count: int, doc: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each of ``count`` files from fields in the files' order."""
    offsets = np.zeros(count + 1, np.int32)
    np.cumsum(np.bincount(doc, minlength=count), out=offsets[1:])
    values = pa.StructArray.from_arrays([*fields.values()], names=[*fields])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
