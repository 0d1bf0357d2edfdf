"""YAML texts to nodes: the one place where Python code runs per row.

Spark has no YAML reader, so one Arrow UDF loads each text once with PyYAML. Only the
nodes a caller names leave Python; everything that is decided about them is decided with
Spark expressions (see `extract`).

A pattern is a tuple that leads from the root to the wanted entries:

    ("jobs", "t", "steps", EACH, "with")   keys of maps, EACH = every item of a list
    ("jobs", DEEP, "api-level")            outermost maps' entries below `jobs`, at any
                                           depth, whose lower-cased key is `api-level`
    ("jobs", "t", "~options")              the map at `t`, and of its entries only those
                                           whose lower-cased key contains `options`

Each match gives one node, and one more per direct child if it is a container. A search that
fails keeps what it has found: `extract_failed` says so, `ok` speaks of the load alone.
"""

from __future__ import annotations

import datetime
import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # the text operators work without it
    yaml = None

EACH = "[]"
DEEP = "**"
LIKE = "~"

NODE_TYPE = (
    "struct<pattern:int,seq:int,is_child:boolean,parent_kind:string,key:string,"
    "key_is_text:boolean,kind:string,value:string,is_digit:boolean>"
)
DOCUMENT_TYPE = (
    "struct<ok:boolean,message:string,is_empty:boolean,root_kind:string,"
    f"has_cycle:boolean,extract_failed:boolean,nodes:array<{NODE_TYPE}>>"
)

_NODE_FIELDS = [
    ("pattern", pa.int32()),
    ("seq", pa.int32()),
    ("is_child", pa.bool_()),
    ("parent_kind", pa.string()),
    ("key", pa.string()),
    ("key_is_text", pa.bool_()),
    ("kind", pa.string()),
    ("value", pa.string()),
    ("is_digit", pa.bool_()),
]
_DOCUMENT_FIELDS = [
    ("ok", pa.bool_()),
    ("message", pa.string()),
    ("is_empty", pa.bool_()),
    ("root_kind", pa.string()),
    ("has_cycle", pa.bool_()),
    ("extract_failed", pa.bool_()),
]

# The compiled loader is some seven times faster than the pure Python one, whose verdict
# is the one to match. They differ on the texts below only (checked by random documents,
# see tests/test_documents.py), which go to the pure loader, as do all texts the compiled
# one rejects and all that nest deeply, where it has no limit and Python has one.
_ODD_CHARACTERS = ("\t", "\r", "\ufeff")
_DIRECTIVE = re.compile("(?:^|[\n\x85\u2028\u2029])%")
_BARE_TAG = re.compile("(?:^|[\\s,\\[\\]{}])!(?:[\\s,<\\[\\]{}]|$)")
_MARKED_BLOCK = re.compile("[|>][0-9+-]*#")
_FLOW_START = re.compile("(?:^|[-?:\n\x85\u2028\u2029]) *[\\[{]|(?:^|\\s)[&!]\\S* +[\\[{]")
_DEEP_INDENT = re.compile("^[ ?:-]{100}", re.MULTILINE)
_DEEP = 100

# Copies of one file are frequent. Each task keeps its latest results for texts up to this
# length, some tens of MB at most.
_COPIES = 1024
_COPY_LENGTH = 16_384

def _needs_pure_loader(text: str) -> bool:
    return (
        not yaml.__with_libyaml__
        or any(c in text for c in _ODD_CHARACTERS)
        or ("%" in text and _DIRECTIVE.search(text) is not None)
        or ("!" in text and _BARE_TAG.search(text) is not None)
        or ("#" in text and _MARKED_BLOCK.search(text) is not None)
        or ("?" in text and _FLOW_START.search(text) is not None)
        or (_may_be_deep(text) and _is_deep(text))
    )


def _may_be_deep(text: str) -> bool:
    brackets = text.count("[") + text.count("{") - 2 * text.count("${{")
    return brackets > _DEEP or _DEEP_INDENT.search(text) is not None


def _is_deep(text: str) -> bool:
    """Whether collections nest deeply; reads the events, which takes no recursion."""
    depth = 0
    try:
        for event in yaml.parse(text, Loader=yaml.CSafeLoader):
            if isinstance(event, yaml.CollectionStartEvent):
                depth += 1
                if depth > _DEEP:
                    return True
            elif isinstance(event, yaml.CollectionEndEvent):
                depth -= 1
    except yaml.YAMLError:
        return True
    return False


class _Merging:
    """Merge keys copy entries, and a chain of them can double its entries at every step. Of
    entries that are the same pair of nodes, the first one decides the place and the last one
    the value; those between them are left out, so that a map keeps a size in proportion to
    the text."""

    def flatten_mapping(self, node):
        super().flatten_mapping(node)
        marks = [(id(key), id(value)) for key, value in node.value]
        if len(set(marks)) < len(marks):
            first = {mark: i for i, mark in reversed(list(enumerate(marks)))}
            last = {mark: i for i, mark in enumerate(marks)}
            node.value = [node.value[i] for i in sorted({*first.values(), *last.values()})]


if yaml is not None:

    class _PureLoader(_Merging, yaml.SafeLoader):
        pass

    class _CompiledLoader(_Merging, getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    _SCALAR_NODE, _SEQUENCE_NODE, _MAPPING_NODE = yaml.ScalarNode, yaml.SequenceNode, yaml.MappingNode
    # Scalars are constructed without any state.
    _CONSTRUCTOR = yaml.constructor.SafeConstructor()

    class _Composer(getattr(yaml.cyaml, "CParser", object) if yaml.__with_libyaml__ else object):
        """Nodes of the compiled parser, with the tags that the safe loader gives them. `plain` keeps the
        tags of short plain scalars, of which many are alike."""

        def __init__(self, text, plain):
            super().__init__(text)
            self.plain = plain

        def descend_resolver(self, parent, index):
            pass

        def ascend_resolver(self):
            pass

        def resolve(self, kind, value, implicit):
            if kind is not _SCALAR_NODE:
                return _SEQ if kind is _SEQUENCE_NODE else _MAP
            if not implicit[0]:
                return _STR
            tag = self.plain.get(value)
            if tag is None:
                tag = _plain_tag(value)
                if len(value) <= _PLAIN_LENGTH:
                    if len(self.plain) >= _PLAIN:
                        self.plain.clear()
                    self.plain[value] = tag
            return tag


_STR, _SEQ, _MAP = "tag:yaml.org,2002:str", "tag:yaml.org,2002:seq", "tag:yaml.org,2002:map"
_NULL, _INT = "tag:yaml.org,2002:null", "tag:yaml.org,2002:int"
_SCALAR_TAGS = (_INT, "tag:yaml.org,2002:bool", "tag:yaml.org,2002:float", "tag:yaml.org,2002:timestamp")
# Plain scalars of up to this length whose tags a task keeps, a MB or so.
_PLAIN, _PLAIN_LENGTH = 4096, 40
_PLAIN_TAGS: dict[str, str] = {}


def _plain_tag(value):
    for tag, regexp in yaml.SafeLoader.yaml_implicit_resolvers.get(value[:1], ()):
        if regexp.match(value):
            return tag
    return _STR


class _Unusual(Exception):
    """Nodes that `_built` leaves to the loaders."""


def _built(node, made):
    """What the safe loader constructs of a node, by plain recursion. Merge keys, keys that are containers
    and all but the usual tags are unusual. An alias is the object of its anchor, kept in `made`."""
    tag, kind = node.tag, type(node)
    if kind is _SCALAR_NODE:
        return node.value if tag == _STR else _scalar_built(node, tag)
    if node in made:
        return made[node]
    if kind is _MAPPING_NODE and tag == _MAP:
        made[node] = entries = {}
        for key, child in node.value:
            if type(key) is not _SCALAR_NODE:
                raise _Unusual
            name = key.value if key.tag == _STR else _scalar_built(key, key.tag)
            if type(child) is _SCALAR_NODE and child.tag == _STR:
                entries[name] = child.value
            else:
                entries[name] = _built(child, made)
        return entries
    if kind is _SEQUENCE_NODE and tag == _SEQ:
        made[node] = items = []
        for child in node.value:
            items.append(_built(child, made))
        return items
    raise _Unusual


def _scalar_built(node, tag):
    if tag == _INT:
        value = node.value
        # Decimal digits only: after a leading zero or with colons the base is another one.
        if value.isascii() and value.isdigit() and value[0] != "0":
            return int(value)
    elif tag == _NULL:
        return None
    elif tag not in _SCALAR_TAGS:
        raise _Unusual
    return yaml.SafeLoader.yaml_constructors[tag](_CONSTRUCTOR, node)


# Lines of the plainest kind of text: an entry of a map, an item of a list, or an item that is a map and opens with
# its first entry. Everything else is left to the parser: further lines of a value, block texts, anchors, tags,
# documents, keys that are no words.
_NOT_PLAIN = re.compile("[^ -~\n]|[&*!]")
_LINE = re.compile("( *)(- )?(?:([A-Za-z_][A-Za-z0-9_./-]*):(?: +|$))?(.*)")
_PLAIN_VALUE = re.compile("(?!.*:(?: |$))(?:[A-Za-z0-9_./$+]|-[A-Za-z0-9])")
_QUOTED_OR_FLOW = ("[", "{", '"', "'")
_LONG_LINE = 500
_LINES: dict[str, tuple] = {}


def _line(line):
    """(column, whether it is an item, key or None, value): a scalar's value is in a list, a container is its node."""
    indent, dash, key, value = _LINE.fullmatch(line).groups()
    if len(line) > _LONG_LINE:
        raise _Unusual
    # Where a value may stand, `#` opens a comment; in a plain one it does so after a space.
    value = value if value[:1] in _QUOTED_OR_FLOW else f" {value}".split(" #", 1)[0].strip(" ")
    if not value:
        if key is None:
            raise _Unusual
        held = None
    elif _PLAIN_VALUE.match(value):
        held = [_scalar_of(value)]
    elif value[0] in _QUOTED_OR_FLOW:
        composer = _Composer(value, _PLAIN_TAGS)
        try:
            held = composer.get_single_node()
        finally:
            composer.dispose()
        # Of a block, this is the first key.
        if type(held) is _SCALAR_NODE:
            held = [held.value]
        elif not held.flow_style:
            raise _Unusual
    else:
        raise _Unusual
    return len(indent), dash is not None, None if key is None else (_scalar_of(key),), held


def _scalar_of(plain):
    tag = _plain_tag(plain)
    return plain if tag == _STR else _scalar_built(yaml.ScalarNode(tag, plain), tag)


def _plainly(text: str):
    """`yaml.safe_load` of a text of plain lines by their columns; `_Unusual`, or what the parser raises, of any other.

    `open_` holds the containers around a line with their columns, `waiting` the map, key and column of an
    entry whose value has not come."""
    if _NOT_PLAIN.search(text):
        raise _Unusual
    open_, root, waiting = [], None, (None, None, -1)
    for line in text.split("\n"):
        read = _LINES.get(line)
        if read is None:
            stripped = line.lstrip(" ")
            if not stripped or stripped[0] == "#":
                if not stripped and line:
                    raise _Unusual
                continue
            read = _line(line)
            if len(_LINES) >= _PLAIN:
                _LINES.clear()
            _LINES[line] = read
        column, is_item, key, held = read
        if waiting is not None:
            parent, name, at = waiting
            waiting = None
            if column > at or (is_item and column == at):
                child = [] if is_item else {}
                open_.append((column, child))
                if parent is None:
                    root = child
                else:
                    parent[name] = child
        while open_ and open_[-1][0] > column:
            open_.pop()
        if open_ and not is_item and type(open_[-1][1]) is list:
            # A list in the column of the key that it belongs to.
            open_.pop()
        if not open_ or open_[-1][0] != column or (type(open_[-1][1]) is list) != is_item:
            raise _Unusual
        into = open_[-1][1]
        if key is None:
            if not is_item:
                raise _Unusual
            into.append(held[0] if type(held) is list else _built(held, {}))
            continue
        if is_item:
            column += 2
            entries = {}
            into.append(entries)
            open_.append((column, entries))
            into = entries
        if held is None:
            into[key[0]] = None
            waiting = into, key[0], column
        else:
            into[key[0]] = held[0] if type(held) is list else _built(held, {})
    if root is None:
        raise _Unusual
    return root


def _second_document(text: str, failure: Exception) -> Exception | None:
    """What the pure loader says of a text whose first document the compiled one has taken and that goes on
    after it: its marks quote the text. None of any other failure, and where there may be tags, which
    the two read differently."""
    if not isinstance(failure, yaml.composer.ComposerError) or failure.context != _SINGLE or "!" in text:
        return None
    marks = [
        yaml.Mark("<unicode string>", m.index, m.line, m.column, text + "\0", m.index)
        for m in (failure.context_mark, failure.problem_mark)
    ]
    return yaml.composer.ComposerError(failure.context, marks[0], failure.problem, marks[1])


_SINGLE = "expected a single document in the stream"
_OPEN_FLOWS = {"while parsing a flow sequence": "]", "while parsing a flow mapping": "}"}


def _open_flow(text: str, failure: Exception) -> Exception | None:
    """What the pure loader says of a list or map in brackets that is not closed before the text ends or a colon comes
    that belongs to no key. None of any other failure, and where there may be tags."""
    closing = _OPEN_FLOWS.get(failure.context) if isinstance(failure, yaml.parser.ParserError) else None
    if closing is None or failure.problem != f"did not find expected ',' or '{closing}'" or "!" in text or not text.isascii():
        return None
    start, at = failure.context_mark, failure.problem_mark.index
    if at >= len(text):
        at, token = len(text), "<stream end>"
    elif text[at] == ":" and text[at + 1 : at + 2] in ("", " ", "\n"):
        token = ":"
    else:
        return None
    buffer = text + "\0"
    return yaml.parser.ParserError(
        failure.context,
        yaml.Mark("<unicode string>", start.index, start.line, start.column, buffer, start.index),
        f"expected ',' or '{closing}', but got {token!r}",
        yaml.Mark("<unicode string>", at, text.count("\n", 0, at), at - text.rfind("\n", 0, at) - 1, buffer, at),
    )


def load(text: str, try_plainly=True):
    """What `yaml.safe_load` gives or raises, by the fastest way that agrees with it. `_plainly` can be spared for a text
    that is known to have other lines."""
    if _needs_pure_loader(text):
        return yaml.load(text, Loader=_PureLoader)
    if try_plainly:
        try:
            return _plainly(text)
        except Exception:
            pass
    composer = _Composer(text, _PLAIN_TAGS)
    try:
        node = composer.get_single_node()
    except Exception as failure:
        told = _second_document(text, failure) or _open_flow(text, failure)
    else:
        try:
            return None if node is None else _built(node, {})
        except Exception:
            pass
        try:
            return yaml.load(text, Loader=_CompiledLoader)
        except Exception:
            told = None
    finally:
        composer.dispose()
    if told is not None:
        raise told
    return yaml.load(text, Loader=_PureLoader)


_KINDS = {
    dict: "map",
    list: "list",
    str: "str",
    bool: "bool",
    int: "int",
    float: "float",
    type(None): "null",
    datetime.datetime: "datetime",
    datetime.date: "date",
    bytes: "bytes",
    set: "set",
    tuple: "tuple",
}


def _kind(value) -> str:
    return _KINDS.get(type(value), type(value).__name__)


def _along(value, path):
    """Yield the values that a path of keys and EACH leads to."""
    if not path:
        yield value
    elif path[0] == EACH:
        for item in value if isinstance(value, list) else ():
            yield from _along(item, path[1:])
    elif isinstance(value, dict) and path[0] in value:
        yield from _along(value[path[0]], path[1:])


def _outermost_of_tree(start, wanted):
    """`_outermost` of a document without aliases: nothing is shared, so nothing is marked."""
    found, todo = [], [start] if isinstance(start, (dict, list)) else []
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo += [item for item in value if isinstance(item, (dict, list))]
        else:
            for key, entry in value.items():
                if isinstance(key, str) and key.lower() == wanted:
                    found.append(entry)
                elif isinstance(entry, (dict, list)):
                    todo.append(entry)
    return found


def _outermost(start, wanted):
    """Values under a key equal to `wanted`, at any depth but never below a match.

    Visits a container that aliases share once, as only the set of values counts, and
    tells whether some visited container holds itself.
    """
    found, cyclic = [], False
    active, done, todo = set(), set(), [start]
    while todo:
        value = todo.pop()
        if type(value) is _Leaving:
            active.discard(value.mark)
            done.add(value.mark)
            continue
        mark = id(value)
        if mark in active:
            cyclic = True
        elif mark not in done and isinstance(value, (dict, list)):
            active.add(mark)
            todo.append(_Leaving(mark))
            if isinstance(value, list):
                todo += [item for item in value if isinstance(item, (dict, list))]
            else:
                for key, entry in value.items():
                    if isinstance(key, str) and key.lower() == wanted:
                        found.append(entry)
                    elif isinstance(entry, (dict, list)):
                        todo.append(entry)
    return found, cyclic


class _Leaving:
    """On the list of things to do: all below the container with this id is done."""

    def __init__(self, mark):
        self.mark = mark


def _scalar(value):
    """Text of a scalar; containers have none."""
    return None if isinstance(value, (dict, list, set, tuple)) else str(value)


def _text(value):
    """Text of the value at a key; NULL if it has none. The key counts all the same."""
    try:
        return str(value)
    except Exception:
        return None


def _match_rows(number, match, rows, deep, like):
    """Append the node of a match and those of its wanted children."""
    kind = _kind(match)
    text = _scalar(match)
    rows.append((number, len(rows), False, None, None, None, kind, text, _digits(text)))
    if like is not None:
        # Only the wanted keys, and those that are no text, which end a scan.
        for key, child in match.items() if isinstance(match, dict) else ():
            if not isinstance(key, str):
                rows.append((number, len(rows), True, kind, None, False, _kind(child), None, False))
            elif like in key.lower():
                text = str(child)
                rows.append((number, len(rows), True, kind, key, True, _kind(child), text, _digits(text)))
        return
    if isinstance(match, dict):
        for key, child in match.items():
            text = _scalar(child) if deep else _text(child)
            rows.append(
                (number, len(rows), True, kind, str(key), isinstance(key, str), _kind(child), text, _digits(text))
            )
    elif isinstance(match, (list, set, bytes)):
        for child in match:
            text = _scalar(child) if deep else str(child)
            rows.append((number, len(rows), True, kind, None, False, _kind(child), text, _digits(text)))


def _nodes(root, patterns, aliases=True):
    """Rows in the order of NODE_TYPE, whether a DEEP search met a cycle, and whether the
    search of some pattern failed. What was found before a failure stays."""
    rows, cyclic, failed = [], False, False
    for number, pattern in enumerate(patterns):
        deep = DEEP in pattern
        like = None
        if pattern and pattern[-1].startswith(LIKE):
            like, pattern = pattern[-1][len(LIKE) :], pattern[:-1]
        try:
            if deep:
                start, wanted = pattern[: pattern.index(DEEP)], pattern[-1]
                matches = []
                for value in _along(root, start):
                    found, loops = _outermost(value, wanted) if aliases else (_outermost_of_tree(value, wanted), False)
                    matches += found
                    cyclic |= loops
            else:
                matches = _along(root, pattern)
            for match in matches:
                _match_rows(number, match, rows, deep, like)
        except Exception:
            failed = True
    return rows, cyclic, failed


def _digits(text) -> bool:
    return text is not None and text.isdigit()


def read_document(text: str, patterns=(), try_plainly=True):
    """(ok, message, is_empty, root_kind, has_cycle, extract_failed), node rows.

    `ok` and the message speak of the load alone."""
    try:
        root = load(text, try_plainly)
    except Exception as failure:
        return (False, str(failure) or type(failure).__name__, False, None, False, False), []
    rows, cyclic, failed = _nodes(root, patterns, "*" in text)
    return (True, None, not root, _kind(root), cyclic, failed), rows


def _valid(text):
    # A quoted escape may name half of a surrogate pair, which no UTF-8 column can hold; it
    # is written as an escape again.
    return text.encode("utf-8", "backslashreplace").decode() if isinstance(text, str) else text


def _column(values, type_):
    if type_ == pa.string():
        try:
            return pa.array(values, type_)
        except UnicodeEncodeError:
            return pa.array([_valid(v) for v in values], type_)
    return pa.array(values, type_)


def _struct(fields, rows):
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.StructArray.from_arrays(
        [_column(values, type_) for values, (_, type_) in zip(columns, fields)],
        names=[name for name, _ in fields],
    )


# Texts of plain lines are read together, a block of them at a time: each distinct line is read once by `_line`, and
# what belongs to what follows from columns, for all lines of a block by array operations. What `_plainly` would
# leave to the parser is left to it here as well, and so are keys that stand twice in a map.
_BLOCK_BYTES = 1 << 21
_WIDEST = 60
_LEFT = "[^ -~\n]|[&*!]|(?m:[|>][0-9+-]* *$)"
# Lines that are read all at once: an entry or item whose value is a word or words, a whole number, or not there.
_IN_WORD = r"""["$%'()+,./0-9;<=@A-Z\\\]^_a-z}~-]"""
_SIMPLE = (
    r"^(?P<indent> *)(?P<dash>- )?(?:(?P<key>[A-Za-z_][A-Za-z0-9_./-]*):(?: +|$))?"
    rf"(?P<value>(?:-?[A-Za-z]{_IN_WORD}*(?: +{_IN_WORD}+)*|[1-9][0-9]{{0,15}})?)$"
)
_NOT_STRINGS = [x for w in ("yes", "no", "true", "false", "on", "off", "null") for x in (w, w.capitalize(), w.upper())]
_NO_KEY, _ABSENT = -1, -2
_SEQ_FIELD = 1


class _Lines:
    """What the distinct lines of a block say, an array per property. Keys are numbered as maps tell them apart;
    `held` is the place of the value, or -1."""

    def __init__(self, lines: pa.Array):
        n = len(lines)
        self.lines, self.keys, self.read = lines, {}, {}
        self.item, self.empty, self.skipped, self.left, self.asks, self.flows = (np.zeros(n, bool) for _ in range(6))
        self.column, self.brackets = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.key, self.held = np.full(n, _NO_KEY), np.full(n, -1)
        self.container = np.zeros(n + 1, bool)
        simple = pc.extract_regex(lines, _SIMPLE)
        indent, dash, key, self.values = (pc.struct_field(simple, name) for name in ("indent", "dash", "key", "value"))
        self.column[:] = _numbers(pc.binary_length(indent))
        self.item[:] = _numbers(pc.binary_length(dash)) > 0
        self.empty[:] = _numbers(pc.binary_length(self.values)) == 0
        named = _numbers(pc.binary_length(key)) > 0
        done = ~_numbers(pc.is_null(simple)).astype(bool) & (named | self.item & ~self.empty)
        done &= (self.column <= _WIDEST) & (_numbers(pc.binary_length(lines)) <= _LONG_LINE)
        done &= ~_numbers(pc.is_in(self.values, pa.array(_NOT_STRINGS))).astype(bool)
        coded = pc.fill_null(key, "").dictionary_encode()
        numbers = [_NO_KEY if not k else self._numbered(_scalar_of(k)) for k in coded.dictionary.to_pylist()]
        self.key[:] = np.array(numbers, np.int64)[_numbers(coded.indices)] if n else 0
        self.held[done & ~self.empty] = np.flatnonzero(done & ~self.empty)
        others = np.flatnonzero(~done)
        for i, line in zip(others.tolist(), lines.take(pa.array(others)).to_pylist()):
            self._line(i, line)

    def _numbered(self, key):
        return self.keys.setdefault(key, len(self.keys))

    def _line(self, i, line):
        self.column[i], self.item[i], self.empty[i], self.key[i] = 0, False, False, _NO_KEY
        known = _FLOWS.get(line)
        if known is not None:
            self._take(i, *known)
            return
        asks, flows = "?" in line, _FLOW_START.search(line) is not None
        brackets = line.count("[") + line.count("{") - 2 * line.count("${{")
        self.asks[i], self.flows[i], self.brackets[i] = asks, flows, brackets
        stripped = line.lstrip(" ")
        if (
            _NOT_PLAIN.search(line) is not None
            or line.startswith("%")
            or ("#" in line and _MARKED_BLOCK.search(line) is not None)
            or _DEEP_INDENT.match(line) is not None
            or (line and not stripped)
        ):
            self.left[i] = True
        elif not line or stripped[0] == "#":
            self.skipped[i] = True
        else:
            try:
                read = _with_flow(line)
            except Exception:
                self.left[i] = True
                return
            if (read[2] is None and not read[1]) or read[0] > _WIDEST:
                self.left[i] = True
                return
            # Those lines cost most, so the latest are kept.
            if len(_FLOWS) >= _PLAIN:
                _FLOWS.clear()
            _FLOWS[line] = (asks, flows, brackets, read)
            self._take(i, asks, flows, brackets, read)

    def _take(self, i, asks, flows, brackets, read):
        self.asks[i], self.flows[i], self.brackets[i] = asks, flows, brackets
        column, is_item, key, value = read
        self.column[i], self.item[i], self.empty[i] = column, is_item, value is None
        if key is not None:
            self.key[i] = self._numbered(key[0])
        if value is not None:
            self.held[i], self.read[i] = i, value[0]
            self.container[i] = isinstance(value[0], (dict, list))

    def value(self, place):
        """The value at a place, as the loaders give it."""
        if place < 0:
            return None
        if place in self.read:
            return self.read[place]
        text = self.values[place].as_py()
        return int(text) if text[0].isdigit() else text


_FLOWS: dict[str, tuple] = {}


def _with_flow(line):
    """`_line` with the value of a container built."""
    column, is_item, key, value = _line(line)
    return column, is_item, key, value if value is None or type(value) is list else [_built(value, {})]


def _numbers(array):
    if array.null_count:
        array = pc.fill_null(array, False if pa.types.is_boolean(array.type) else 0)
    return array.to_numpy(zero_copy_only=False)


class _Block:
    """The lines of some texts as elements: an item or an entry each, an item that opens with an entry two. The
    rank of an element, twice its column and one more for an item, is the same for all elements of a container and
    larger than that of the element which holds the container. `parent` is that element, or `n` for the root."""

    def __init__(self, texts: pa.Array):
        lines = pc.split_pattern(texts, "\n")
        coded = lines.flatten().dictionary_encode()
        self.lines = distinct = _Lines(coded.dictionary)
        self.keys = distinct.keys
        line = _numbers(coded.indices)
        text = np.repeat(np.arange(len(texts)), _numbers(pc.list_value_length(lines)))

        def texts_with(feature):
            return np.bincount(text, feature[line], len(texts))

        self.left = texts_with(distinct.left) > 0
        self.left |= (texts_with(distinct.asks) > 0) & (texts_with(distinct.flows) > 0)
        self.left |= texts_with(distinct.brackets) > _DEEP
        keep = ~distinct.skipped[line]
        # Nothing but comments and empty lines is an empty document.
        self.void = ~self.left & (texts_with(~distinct.skipped) == 0)
        line, text = line[keep], text[keep]
        item, key = distinct.item[line], distinct.key[line]
        pair = item & (key != _NO_KEY)
        place = np.cumsum(1 + pair) - 1
        self.n = n = int(place[-1]) + 1 if len(place) else 0
        # An item that opens with an entry stands before its entry, in the same line.
        self.text, self.line, self.rank = (np.zeros(n, np.int64) for _ in range(3))
        self.key, self.holds = np.full(n, _NO_KEY), np.zeros(n, bool)
        self.value, self.is_item = np.full(n, -1), np.zeros(n, bool)
        column = distinct.column[line]
        self.text[place], self.key[place] = text, key
        self.rank[place] = np.where(item, np.where(pair, 2 * column + 4, 2 * column + 1), 2 * column)
        self.value[place], self.holds[place] = distinct.held[line], distinct.empty[line]
        self.is_item[place] = item & ~pair
        opening = place[pair] - 1
        self.is_item[opening] = True
        self.text[opening], self.rank[opening], self.holds[opening] = text[pair], 2 * column[pair] + 1, True
        self._link()

    def _link(self):
        n, rank, text = self.n, self.rank, self.text
        at = np.arange(n)
        first = np.r_[True, text[1:] != text[:-1]] if n else np.zeros(0, bool)
        before, container = np.full(n, -1), np.zeros(n, np.int64)
        ranks = np.flatnonzero(np.bincount(rank)) if n else []
        places = [np.flatnonzero(rank == r) for r in ranks]
        for r, here in zip(ranks, places):
            last = np.maximum.accumulate(np.where(rank <= r, at, -1))
            before[here] = np.where(here > 0, last[here - 1], -1)
        before[(before >= 0) & (text[before] != text)] = -1
        lost = (before < 0) & ~first
        beside = (before >= 0) & (rank[before] == rank)
        opens = ~first & ~beside & ~lost
        lost |= opens & ((before != at - 1) | ~self.holds[before])
        for here in places:
            container[here] = here[np.maximum.accumulate(np.where(~beside[here], np.arange(len(here)), 0))]
        self.left[text[lost]] = True
        self.parent = np.where(first[container], n, before[container])
        # Whether the value of an element is the container that the next one opens.
        self.opened = np.r_[opens[1:] & (before[1:] == at[:-1]), False] if n else opens
        entries, self.names = self.key != _NO_KEY, list(self.keys)
        named = np.sort(container[entries] * (len(self.keys) + 1) + self.key[entries])
        twice = named[1:][named[1:] == named[:-1]] // (len(self.keys) + 1)
        self.left[text[twice]] = True
        self.map_root = np.zeros(len(self.left), bool)
        self.map_root[text[first]] = entries[first]

    def built(self, at):
        """The value of an element as the loaders give it."""
        if not self.opened[at]:
            return self.lines.value(int(self.value[at]))
        rank, text, names = self.rank[at + 1], self.text[at], self.names
        children, y = [], at + 1
        while y < self.n and self.text[y] == text and self.rank[y] >= rank:
            if self.rank[y] == rank:
                children.append(y)
            y += 1
        if self.key[at + 1] == _NO_KEY:
            return [self.built(y) for y in children]
        return {names[self.key[y]]: self.built(y) for y in children}

    def found(self, pattern):
        """What `_nodes` finds by a pattern: (elements, how) in parts. `how` is None if the values of the elements
        match, else the search that goes on within a value that is a container in its line."""
        n, deep = self.n, DEEP in pattern
        path = pattern[: pattern.index(DEEP)] if deep else pattern
        inside = np.zeros(n + 1, bool)
        inside[n] = True
        parts = []
        for i, step in enumerate(path):
            parts.append((self._flow(inside), lambda value, rest=path[i:]: _searched(value, rest, pattern)))
            mine = self.is_item if step == EACH else self.key == self.keys.get(step, _ABSENT)
            inside = np.r_[mine & inside[self.parent], False]
        if not deep:
            return [*parts, (np.flatnonzero(inside[:n]), None)]
        wanted = np.array([isinstance(k, str) and k.lower() == pattern[-1] for k in self.keys] + [False], bool)[self.key]
        below, closed = inside[self.parent], np.r_[wanted, True]
        while True:
            reached = below | (np.r_[below, False] & ~closed)[self.parent]
            if (reached == below).all():
                break
            below = reached
        inside[:n] |= below & ~wanted
        parts.append((self._flow(inside), lambda value: _searched(value, (), pattern)))
        return [*parts, (np.flatnonzero(below & wanted), None)]

    def _flow(self, inside):
        """Elements whose value is a container in its line."""
        return np.flatnonzero(inside[: self.n] & self.lines.container[self.value])

    def order(self, at, in_value, starts):
        """The order in which the search comes to elements. From the depth of `starts` on it goes into the last container
        first, and reads the entries of a container before it goes on."""
        keys, above = [], np.where(in_value, at, self.parent[at])
        while (above < self.n).any():
            keys.append(above)
            above = np.r_[self.parent, self.n][above]
        depth = sum((k < self.n for k in keys), np.zeros(len(at), np.int64))
        levels = np.full((len(keys), len(at)), -self.n - 1)
        for up, above in enumerate(keys):
            here = above < self.n
            level = (depth - 1 - up)[here]
            levels[level, np.flatnonzero(here)] = np.where(level < starts, above[here], -above[here])
        return np.lexsort((at, *levels[::-1], self.text[at]))


def _searched(value, rest, pattern):
    values = _along(value, rest)
    if DEEP in pattern:
        return [x for v in values for x in _outermost_of_tree(v, pattern[-1])]
    return list(values)


_ROOTS = ("list", "map", "null")


def _plain_nodes(texts: pa.Array, patterns):
    """(which texts are left to `load`, the kinds of their roots as places in `_ROOTS`, texts and places of their nodes'
    rows in `rows`, `rows`) for texts of plain lines."""
    block = _Block(texts)
    rows, starts, lengths, owners = [], [], [], []

    def put(matches, number, pattern):
        start = len(rows)
        like = pattern[-1][len(LIKE) :] if pattern and pattern[-1].startswith(LIKE) else None
        for match in matches:
            _match_rows(number, match, rows, DEEP in pattern, like)
        return start, len(rows) - start

    for number, pattern in enumerate(patterns):
        path = pattern[:-1] if pattern and pattern[-1].startswith(LIKE) else pattern
        at, in_value, spans = [], [], []
        for elements, how in block.found(path):
            # Values that stand in the same kind of line are looked at once.
            _, firsts, kinds = np.unique(
                np.where(block.opened[elements], elements, -2 - block.value[elements]), return_index=True, return_inverse=True
            )
            found = np.zeros((len(firsts), 2), np.int64)
            for i, x in enumerate(elements[firsts].tolist()):
                try:
                    value = block.built(x)
                    found[i] = put([value] if how is None else how(value), number, pattern)
                except Exception:
                    block.left[block.text[elements[kinds == i]]] = True
            found = found[kinds]
            some = found[:, 1] > 0
            at.append(elements[some])
            in_value.append(np.full(some.sum(), how is not None))
            spans.append(found[some])
        at, in_value, spans = np.concatenate(at), np.concatenate(in_value), np.concatenate(spans)
        if DEEP in path:
            order = block.order(at, in_value, path.index(DEEP))
        else:
            order = np.argsort(at, kind="stable")
        owners.append(block.text[at[order]])
        starts.append(spans[order, 0])
        lengths.append(spans[order, 1])
    roots = np.where(block.void, 2, np.where(block.map_root, 1, 0))
    if not owners:
        return block.left, roots, np.zeros(0, np.int64), np.zeros(0, np.int64), rows
    owners, starts, lengths = map(np.concatenate, (owners, starts, lengths))
    order = np.argsort(owners, kind="stable")
    owners, starts, lengths = owners[order], starts[order], lengths[order]
    places = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    return block.left, roots, np.repeat(owners, lengths), places, rows


def _blocks(texts: pa.Array):
    """A batch in blocks of bounded bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // _BLOCK_BYTES
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def _read_block(texts: pa.Array, patterns, read, read_other=None):
    """DOCUMENT_TYPE of some texts; `read` is `read_document` for those that are not read together, `read_other` for those
    of them that were found to have other than plain lines."""
    size = len(texts)
    left, roots, given_up = np.ones(size, bool), np.zeros(size, np.int64), np.zeros(size, bool)
    owners, places, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    # The root itself is no element.
    if yaml.__with_libyaml__ and all(p and not p[0].startswith(LIKE) for p in patterns):
        tried = pc.and_(
            pc.invert(pc.match_substring_regex(texts, _LEFT)), pc.less(pc.binary_length(texts), _BLOCK_BYTES)
        )
        tried = np.flatnonzero(pc.fill_null(tried, False).to_numpy(zero_copy_only=False))
        if len(tried):
            left_out, kinds, owners, places, rows = _plain_nodes(texts.take(pa.array(tried)), patterns)
            left[tried], roots[tried], given_up[tried] = left_out, kinds, left_out
            plain = ~left_out[owners]
            owners, places = tried[owners[plain]], places[plain]
    # The heads of texts of plain lines are of three kinds, one by root; those of the others follow.
    heads = [(True, None, kind == "null", kind, False, False) for kind in _ROOTS]
    absent = texts.is_null().to_numpy(zero_copy_only=False)
    slow = np.flatnonzero(left)
    more = []
    roots[slow] = len(heads) + np.arange(len(slow))
    for i, text, other in zip(slow.tolist(), texts.take(pa.array(slow)).to_pylist(), given_up[slow].tolist()):
        head, own = ((None,) * len(_DOCUMENT_FIELDS), []) if text is None else (read_other if other and read_other else read)(text, patterns)
        heads.append(head)
        more.append((i, len(rows), len(own)))
        rows += own
    if more:
        i, start, length = np.array(more, np.int64).T
        owners = np.r_[owners, np.repeat(i, length)]
        places = np.r_[places, np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)]
        order = np.argsort(owners, kind="stable")
        owners, places = owners[order], places[order]
    offsets = np.r_[0, np.cumsum(np.bincount(owners, minlength=size))]
    table = _struct(_NODE_FIELDS, rows).take(pa.array(places))
    nodes = table.flatten()
    nodes[_SEQ_FIELD] = pa.array((np.arange(len(owners)) - offsets[owners]).astype(np.int32))
    nodes = pa.StructArray.from_arrays(nodes, names=[name for name, _ in _NODE_FIELDS])
    return pa.StructArray.from_arrays(
        [*_struct(_DOCUMENT_FIELDS, heads).take(pa.array(roots)).flatten(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)],
        names=[name for name, _ in _DOCUMENT_FIELDS] + ["nodes"],
        mask=pa.array(absent, pa.bool_()),
    )


def _struct_type():
    nodes = pa.list_(pa.struct(_NODE_FIELDS))
    return pa.struct([*_DOCUMENT_FIELDS, ("nodes", nodes)])


def documents(text: Column, patterns=()) -> Column:
    """Load a normalised text; NULL in gives NULL out. `patterns` name the nodes to return.

    Marked as non-deterministic so that the optimizer never runs it twice for one row.
    """
    if yaml is None:
        raise ImportError("PyYAML is needed on the driver and on the executors to read YAML")
    patterns = tuple(tuple(p) for p in patterns)

    @F.arrow_udf(DOCUMENT_TYPE)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read_again = functools.lru_cache(_COPIES)(read_document)

        def read_one(text, patterns, try_plainly=True):
            return (read_again if len(text) <= _COPY_LENGTH else read_document)(text, patterns, try_plainly)

        read_other = functools.partial(read_one, try_plainly=False)

        for texts in batches:
            blocks = [_read_block(block, patterns, read_one, read_other) for block in _blocks(texts)]
            yield pa.concat_arrays(blocks) if blocks else pa.array([], _struct_type())

    return read.asNondeterministic()(text)


# Executors need PyYAML but not this package: the functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
