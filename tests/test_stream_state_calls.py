"""The stitch asks its state only for what can be there: every call is a round trip to the JVM."""
from __future__ import annotations

from collections import Counter

from wagelens.sources.lines import CLOSES, OPENS
from wagelens.streaming.records import Stitcher


class Handle:
    """A key's state in memory, counting the calls."""

    def __init__(self):
        self.calls, self.value, self.list, self.map = Counter(), None, [], {}

    def getValueState(self, name, schema):
        return Part(self, exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def getListState(self, name, schema):
        return Part(self, get=lambda: iter(self.list), clear=self.list.clear, appendList=self.list.extend,
                    put=lambda rows: self.list.__setitem__(slice(None), rows))

    def getMapState(self, name, key_schema, value_schema):
        return Part(self, containsKey=self.map.__contains__, getValue=self.map.__getitem__, removeKey=lambda k: self.map.pop(k),
                    updateValue=self.map.__setitem__)


class Part:
    def __init__(self, handle, **calls):
        for name, f in calls.items():
            setattr(self, name, lambda *a, n=name, f=f: (handle.calls.update([n]), f(*a))[1])


class Line(tuple):
    def __getitem__(self, at):
        return tuple.__getitem__(self, ("file", "line_no", "code", "line").index(at) if isinstance(at, str) else at)


def fed(handle, *rows):
    s = Stitcher("|")
    s.init(handle)
    handle.calls.clear()
    return [tuple(r) for r in s.handleInputRows(("f",), iter([Line(("f", *r)) for r in rows]), None)]


def test_a_file_that_comes_whole_costs_one_read_and_one_write():
    h = Handle()
    rows = [(0, 0, b"a"), (1, OPENS, b'"b'), (2, CLOSES, b'c"'), (3, None, None)]
    assert sorted(fed(h, *reversed(rows))) == [("f", 0, 1, "a"), ("f", 1, 2, '"b|c"')]
    assert h.calls == Counter(get=1, update=1)
    assert fed(h, *rows) == []                            # again: nothing new to keep
    assert not h.calls["update"] and not h.calls["clear"] and h.value[:2] == (3, False)


def test_an_open_record_is_kept_and_cleared_once():
    h = Handle()
    assert fed(h, (0, OPENS, b'"a'), (2, 0, b"c")) == []
    assert h.calls == Counter(get=1, updateValue=1, put=1, update=1) and h.list == [(b'"a',)]
    assert fed(h, (1, 0, b"b")) == []                     # the line that came early goes on
    assert h.list == [(b'"a',), (b"b",), (b"c",)] and not h.map
    assert fed(h, (3, CLOSES, b'd"')) == [("f", 0, 4, '"a|b|c|d"')]
    assert h.list == [] and h.calls["clear"] == 1
    assert fed(h, (4, OPENS, b'"e'), (5, 0, b"f")) == [] and len(h.list) == 2
    assert sorted(fed(h, (6, None, None))) == [("f", 4, 1, '"e'), ("f", 5, 1, "f")]
    assert h.list == [] and h.calls["clear"] == 1 and h.value[:2] == (6, False)
