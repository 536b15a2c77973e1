"""Parsers of RDF texts, one document at a time: Turtle, TriG, N-Triples, N-Quads, RDF/XML, JSON-LD. [S-01..S-06]

Each yields (subject, predicate, object), where a subject or object is ("iri", text), ("blank", text) or
("literal", text, language, datatype)."""

from __future__ import annotations

import io
import json
import re
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from ..functions.scalars import slugify

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

Term = tuple
Triple = tuple[Term, str, Term]

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:]))
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:%]|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.\-·:%]|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-·:%]|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\](){}])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


class Turtle:
    """A recursive-descent parser of Turtle and, with the names of graphs dropped, TriG."""

    def __init__(self, text: str, base: str = ""):
        self.text, self.base, self.prefixes = text, base, {}
        self.tokens = self._scan()
        self.next: tuple[str, str] | None = None
        self.out: list[Triple] = []
        self.blanks = 0
        self.mistakes: list[str] = []
        self._advance()

    def _scan(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:  # up to the next blank
                bad = re.compile(r"\S+").match(self.text, at)
                at = bad.end()
                yield "bad", bad[0]
                continue
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]

    def _advance(self) -> tuple[str, str] | None:
        now, self.next = self.next, next(self.tokens, None)
        return now

    def _is(self, mark: str) -> bool:
        return self.next == ("mark", mark)

    def _take(self, mark: str) -> None:
        if not self._is(mark):
            raise ValueError(f"{mark} expected, found {self.next}")
        self._advance()

    def _blank(self) -> Term:
        self.blanks += 1
        return ("blank", f"b{self.blanks}")

    def _iri(self, kind: str, token: str) -> str:
        if kind == "iri":
            iri = unescape(token[1:-1])
            return urllib.parse.urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", iri) else iri
        prefix, _, local = token.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def parse(self) -> Iterator[Triple]:
        """A statement with a mistake gives what stands before it; reading goes on after the next full stop."""
        while self.next:
            try:
                self._statement()
            except (ValueError, TypeError, RecursionError) as e:  # TypeError: the text ends within a statement
                self.mistakes.append(str(e))
                while self.next and not self._is("."):
                    self._advance()
                self._advance()
            yield from self.out
            self.out.clear()

    def _statement(self) -> None:
        kind, token = self.next
        if self._is("}"):  # the end of a graph of which a statement was left out
            self._advance()
            return
        word = token.lower().lstrip("@")
        if (kind == "lang" and word in ("prefix", "base")) or (kind == "word" and word in ("prefix", "base")):
            self._advance()
            name = self._advance()[1] if word == "prefix" else ""
            iri = self._iri("iri", self._advance()[1])
            if word == "prefix":
                self.prefixes[name[:-1]] = iri
            else:
                self.base = iri
            if kind == "lang":
                self._take(".")
            return
        if kind == "word" and word == "graph":
            self._advance()
            kind, token = self.next
        if self._is("{"):
            self._graph()
            return
        if self._is("["):
            subject = self._bracket()
            if self._is("{"):
                self._graph()
                return
            if not self._is("."):
                self._predicates(subject)
        else:
            subject = self._term()
            if self._is("{"):  # the name of a graph
                self._graph()
                return
            self._predicates(subject)
        if not self._is("}"):
            self._take(".")

    def _graph(self) -> None:
        self._take("{")
        while not self._is("}"):
            subject = self._bracket() if self._is("[") else self._term()
            if not (self._is(".") or self._is("}")):
                self._predicates(subject)
            if self._is("."):
                self._advance()
        self._advance()

    def _predicates(self, subject: Term) -> None:
        while True:
            kind, token = self._advance()
            pred = RDF + "type" if (kind, token) == ("word", "a") else self._iri(kind, token)
            while True:
                self.out.append((subject, pred, self._term()))
                if not self._is(","):
                    break
                self._advance()
            if not self._is(";"):
                return
            while self._is(";"):
                self._advance()
            if self.next is None or self.next[0] == "mark":
                return

    def _bracket(self) -> Term:
        self._take("[")
        node = self._blank()
        if not self._is("]"):
            self._predicates(node)
        self._take("]")
        return node

    def _list(self) -> Term:
        self._take("(")
        items = []
        while not self._is(")"):
            items.append(self._term())
        self._advance()
        cells = [self._blank() for _ in items]
        for i, (cell, item) in enumerate(zip(cells, items)):
            self.out.append((cell, RDF + "first", item))
            self.out.append((cell, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else ("iri", RDF + "nil")))
        return cells[0] if cells else ("iri", RDF + "nil")

    def _term(self) -> Term:
        if self._is("["):
            return self._bracket()
        if self._is("("):
            return self._list()
        kind, token = self._advance()
        if kind == "blank":
            return ("blank", token[2:])
        if kind in ("iri", "name"):
            return ("iri", self._iri(kind, token))
        if kind in ("string", "long"):
            text = unescape(token[3:-3] if kind == "long" else token[1:-1])
            if self.next and self.next[0] == "lang":
                return ("literal", text, self._advance()[1][1:].lower(), None)
            if self.next and self.next[0] == "type":
                self._advance()
                return ("literal", text, None, self._iri(*self._advance()))
            return ("literal", text, None, None)
        if kind == "number":
            name = "double" if "e" in token.lower() else "decimal" if "." in token else "integer"
            return ("literal", token, None, XSD + name)
        if kind == "word" and token in ("true", "false"):
            return ("literal", token, None, XSD + "boolean")
        raise ValueError(f"a term expected, found {token}")


def turtle(text: str, base: str = "", mistakes: list[str] | None = None) -> Iterator[Triple]:
    parser = Turtle(text, base)
    parser.mistakes = parser.mistakes if mistakes is None else mistakes
    return parser.parse()


_LINE = re.compile(
    r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:([^\s.]+(?:\.[^\s.]+)*)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*(?:<[^>]*>|_:\S+)?\s*\.\s*(?:\#.*)?$'
)


def ntriples(text: str) -> Iterator[Triple]:
    """N-Triples and N-Quads; lines that are neither are skipped."""
    for line in text.splitlines():
        if m := _LINE.match(line):
            s = ("iri", unescape(m[1])) if m[1] is not None else ("blank", m[2])
            o = ("iri", unescape(m[4])) if m[4] is not None else ("blank", m[5]) if m[5] is not None else ("literal", unescape(m[6]), m[7] and m[7].lower(), m[8])
            yield s, unescape(m[3]), o


def rdf_xml(text: str) -> Iterator[Triple]:
    """RDF/XML: typed nodes, property elements and attributes, parse types, containers and languages."""
    lang_key, base_key = "{http://www.w3.org/XML/1998/namespace}lang", "{http://www.w3.org/XML/1998/namespace}base"
    root, count = ET.fromstring(text), [0]
    full = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def fresh() -> Term:
        count[0] += 1
        return ("blank", f"x{count[0]}")

    def node(e: ET.Element, lang: str | None, base: str) -> Iterator[Triple | Term]:
        lang, base = e.get(lang_key, lang), e.get(base_key, base)
        about, id_, name = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}ID"), e.get(f"{{{RDF}}}nodeID")
        me = ("iri", urllib.parse.urljoin(base, about)) if about is not None else ("iri", f"{base}#{id_}") if id_ else ("blank", name) if name else fresh()
        yield ("node", me)
        if full(e.tag) != RDF + "Description":
            yield me, RDF + "type", ("iri", full(e.tag))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}")):
                yield me, full(k), ("literal", v, lang and lang.lower(), None)
            elif k == f"{{{RDF}}}type":
                yield me, RDF + "type", ("iri", urllib.parse.urljoin(base, v))
        item = 0
        for p in e:
            pred, plang = full(p.tag), p.get(lang_key, lang)
            if pred == RDF + "li":
                item += 1
                pred = f"{RDF}_{item}"
            resource, parse = p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}parseType")
            if resource is not None:
                yield me, pred, ("iri", urllib.parse.urljoin(base, resource))
            elif p.get(f"{{{RDF}}}nodeID"):
                yield me, pred, ("blank", p.get(f"{{{RDF}}}nodeID"))
            elif parse == "Literal":
                inner = (p.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in p)
                yield me, pred, ("literal", inner, None, RDF + "XMLLiteral")
            elif parse == "Resource":
                hidden = ET.Element(f"{{{RDF}}}Description")
                hidden.extend(list(p))
                yield from held(me, pred, hidden, plang, base)
            elif parse == "Collection":
                cells = [fresh() for _ in p] + [("iri", RDF + "nil")]
                yield me, pred, cells[0]
                for i, c in enumerate(p):
                    yield from held(cells[i], RDF + "first", c, plang, base)
                    yield cells[i], RDF + "rest", cells[i + 1]
            elif len(p):
                for c in p:
                    yield from held(me, pred, c, plang, base)
            else:
                datatype = p.get(f"{{{RDF}}}datatype")
                yield me, pred, ("literal", p.text or "", None if datatype else plang and plang.lower(), datatype)

    def held(me: Term, pred: str, child: ET.Element, lang: str | None, base: str) -> Iterator[Triple]:
        for t in node(child, lang, base):
            if t[0] == "node":
                yield me, pred, t[1]
            else:
                yield t

    lang, base = root.get(lang_key), root.get(base_key, "")
    for e in list(root) if full(root.tag) == RDF + "RDF" else [root]:
        yield from (t for t in node(e, lang, base) if t[0] != "node")


def json_ld(text: str) -> Iterator[Triple]:
    """JSON-LD: expanded form, and compact form with a local @context of terms, prefixes, @vocab, @base and @language."""
    count = [0]

    def fresh() -> str:
        count[0] += 1
        return f"_:j{count[0]}"

    def term(value: str) -> Term:
        return ("blank", value[2:]) if value.startswith("_:") else ("iri", value)

    def expand(name: str, ctx: dict, vocab: bool) -> str:
        if name.startswith(("@", "_:")):
            return name
        own = ctx.get(name) if vocab else None
        if own is not None:
            own = own.get("@id", name) if isinstance(own, dict) else own
            return own if own == name else expand(own, ctx, vocab)
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and prefix in ctx:
            base = ctx[prefix]
            return (base["@id"] if isinstance(base, dict) else base) + local
        if colon:
            return name
        return ctx.get("@vocab", "") + name if vocab else urllib.parse.urljoin(ctx.get("@base", ""), name)

    def literal(value, ctx: dict, how: dict) -> Term:
        kind, lang = how.get("@type"), how.get("@language", ctx.get("@language"))
        if isinstance(value, bool):
            return ("literal", "true" if value else "false", None, kind or XSD + "boolean")
        if isinstance(value, int):
            return ("literal", str(value), None, kind or XSD + "integer")
        if isinstance(value, float):
            return ("literal", repr(value), None, kind or XSD + "double")
        return ("literal", value, None if kind or not lang else lang.lower(), kind)

    def value(v, ctx: dict, how: dict) -> Iterator[tuple[Term, list[Triple]]]:
        if v is None:
            return
        if isinstance(v, list):
            for x in v:
                yield from value(x, ctx, how)
        elif isinstance(v, dict) and "@value" in v:
            kind = v.get("@type")
            yield literal(v["@value"], {} if "@language" not in v else ctx, {"@type": kind and expand(kind, ctx, True), "@language": v.get("@language")}), []
        elif isinstance(v, dict) and "@list" in v:
            items = [x for i in v["@list"] for x in value(i, ctx, how)]
            cells, more = [term(fresh()) for _ in items] + [("iri", RDF + "nil")], []
            for i, (t, own) in enumerate(items):
                more += [*own, (cells[i], RDF + "first", t), (cells[i], RDF + "rest", cells[i + 1])]
            yield cells[0], more
        elif isinstance(v, dict) and "@set" in v:
            yield from value(v["@set"], ctx, how)
        elif isinstance(v, dict):
            made = list(node(v, ctx))
            yield made[0], made[1:]
        elif how.get("@type") in ("@id", "@vocab"):
            yield term(expand(v, ctx, how["@type"] == "@vocab")), []
        else:
            kind = how.get("@type")
            yield literal(v, ctx, {**how, "@type": kind and expand(kind, ctx, True)}), []

    def node(n: dict, ctx: dict) -> Iterator:
        """The node's term, then triples."""
        ctx = merged(ctx, n.get("@context"))
        id_ = next((v for k, v in n.items() if expand(k, ctx, True) == "@id"), None)
        me = term(expand(id_, ctx, False) if id_ else fresh())
        yield me
        for k, v in n.items():
            pred, how = expand(k, ctx, True), ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            if pred == "@type":
                for t in v if isinstance(v, list) else [v]:
                    yield me, RDF + "type", term(expand(t, ctx, True))
            elif pred == "@graph":
                for x in v if isinstance(v, list) else [v]:
                    yield from list(node(x, ctx))[1:]
            elif pred == "@reverse":
                for p, xs in v.items():
                    for t, more in value(xs, ctx, {"@type": "@id"}):
                        yield t, expand(p, ctx, True), me
                        yield from more
            elif not pred.startswith("@") and ":" in pred:
                if how.get("@container") == "@language" and isinstance(v, dict):
                    v = [{"@value": x, "@language": lang} for lang, xs in v.items() for x in (xs if isinstance(xs, list) else [xs])]
                if how.get("@container") == "@list":
                    v = {"@list": v if isinstance(v, list) else [v]}
                for t, more in value(v, ctx, how):
                    yield me, pred, t
                    yield from more

    def merged(ctx: dict, more) -> dict:
        if more is None or isinstance(more, str):
            return ctx  # remote contexts are not fetched
        for part in more if isinstance(more, list) else [more]:
            if isinstance(part, dict):
                ctx = {**ctx, **part}
        return ctx

    data = json.loads(text)
    for n in data if isinstance(data, list) else [data]:
        if isinstance(n, dict):
            yield from list(node(n, {}))[1:]


def json_tree(text: str, hash_: str, count: int = 0) -> tuple[list[Triple], int]:
    """JSON as triples: each object a node in document order, tied to the object around it by the name of its
    property; scalars are literals; arrays repeat. [S-08]  Returns the triples and the next number."""
    out: list[Triple] = []
    number = [count]

    stack: list[tuple] = [(json.loads(text), (), None)]
    while stack:
        v, path, parent = stack.pop()
        if isinstance(v, dict):
            me = ("iri", f"urn:json:{hash_}#{number[0]}")
            number[0] += 1
            out.append((me, RDF + "type", ("iri", ":".join([f"urn:json:{hash_}", *path]))))
            if parent and path:
                out.append((me, f"urn:json:{hash_}#{path[-1]}", parent))
            stack += [(x, (*path, slugify(k)), me) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(x, path, parent) for x in reversed(v)]
        elif parent and path and v is not None and v != "":
            kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else None
            text = ("true" if v else "false") if kind == "boolean" else repr(v) if kind == "double" else str(v)
            out.append((parent, f"urn:json:{hash_}#{path[-1]}", ("literal", text, None, kind and XSD + kind)))
    return out, number[0]


def xml_tree(text: str, hash_: str) -> Iterator[Triple]:
    """XML as triples: an element with attributes or elements in it is a node, tied to the one around it; one of
    text alone is a literal of the node around it. [S-10]"""
    local = lambda tag: tag.rpartition("}")[2]
    number, stack = 0, [(ET.parse(io.StringIO(text)).getroot(), None)]
    while stack:
        e, parent = stack.pop()
        tag, pred = local(e.tag), f"urn:xml:pred:{hash_}#{slugify(local(e.tag))}"
        text_ = (e.text or "").strip()
        if not len(e) and not e.attrib and parent:
            if text_:
                yield parent, pred, ("literal", text_, None, None)
            continue
        me = ("iri", f"urn:xml:{hash_}#{number}")
        number += 1
        yield me, RDF + "type", ("iri", f"urn:xml:{hash_}#{slugify(tag)}")
        if parent:
            yield me, pred, parent
        for k, v in e.attrib.items():
            yield me, f"urn:xml:attr:{hash_}#{k}", ("literal", v, None, None)
        if text_ and e.attrib:
            yield me, "urn:xml:text", ("literal", text_, None, None)
        stack += [(c, me) for c in reversed(e)]


def is_rdf_xml(text: str) -> bool:
    """Whether the names that an XML text's first element declares are those of RDF."""
    try:
        for event, what in ET.iterparse(io.StringIO(text), events=("start-ns", "start")):
            if event == "start":
                return False
            if what[1] == RDF:
                return True
    except ET.ParseError:
        pass
    return False
