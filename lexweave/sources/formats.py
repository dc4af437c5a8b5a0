"""Decoders for text, XML, SQLite, archive and binary dictionary files.

A decoder turns the name and bytes of one file into entries and metadata pairs
and runs in an executor; a file is one unit of work, files run in parallel.
"""

from __future__ import annotations

import html
import io
import json
import re
import sqlite3
import struct
import unicodedata
import zipfile
from collections import defaultdict
from itertools import groupby
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

from .base import decode_text, entry, info, resource

_BAR = re.compile(r"(?:(?<!\\)(?:\\\\)*)\|")


def split_bar_ntb(text: str) -> list[str]:
    """Terms of a line with escaped bars, newlines, tabs and backslashes."""
    plain = {"n": "\n", "t": "\t"}
    return [re.sub(r"\\([\\|nt])", lambda m: plain.get(m[1], m[1]), p) for p in _BAR.split(text)]


def split_bar(text: str) -> list[str]:
    return [re.sub(r"\\([\\|])", r"\1", p) for p in _BAR.split(text)]


# --- blocks of lines ----------------------------------------------------------------------


def dictunformat(name: str, content: bytes, headword_separator: str = ";   "):
    """Blocks between lines of underscores: the term, perhaps again, then the definition."""
    for block in re.split(r"(?m)^_+\s*$", decode_text(content)):
        lines = [x.rstrip() for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        term, body = lines[0], []
        for line in lines[1:]:
            if line.lower() == term.lower() and line != term and line.lower() == term:
                term = line
            elif line != term:
                body.append(line)
        text = "\n".join(body)
        if term.startswith("00-database-"):
            if text != "unknown":
                yield info(term.removeprefix("00-database-"), text)
        else:
            yield entry(term.split(headword_separator), text)


def gettext_po(name: str, content: bytes):
    """msgid and msgstr with continuation lines; the header's fields are metadata."""
    fields: dict[str, list[str]] = {}
    state = ""

    def unquote(s: str) -> str:
        s = s.strip()
        s = s[1:-1] if len(s) > 1 and s[0] == s[-1] == '"' else s
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": ""}.get(m[1], m[1]), s)

    def done():
        term, text = "".join(fields.get("msgid", [])), "".join(fields.get("msgstr", []))
        if term and text:
            yield entry(term, text)
        elif text:
            for line in text.split("\n"):
                key, colon, value = line.partition(":")
                if colon:
                    yield info(key.strip(), value.strip())

    for line in [*decode_text(content).split("\n"), "msgid"]:
        line = line.strip()
        if line.startswith("#") or not line:
            continue
        word, _, rest = line.partition(" ")
        if word.startswith('"'):
            fields.setdefault(state, []).append(unquote(line))
            continue
        if word == "msgid":
            yield from done()
            fields = {}
        state = word
        fields[state] = [unquote(rest)]


def kobo_dictfile(name: str, content: bytes):
    """``@`` headword, ``&`` variants, ``:`` notes, then Markdown or an HTML body."""
    terms: list[str] = []
    body: list[str] = []
    for line in [*decode_text(content).split("\n"), "@ "]:
        if line.startswith("@"):
            text = "\n".join(body).strip()
            if terms:
                yield entry(terms, text.removeprefix("<html>").strip(), "h") if text.startswith("<html>") else entry(terms, text)
            terms, body = ([line[1:].strip()] if line[1:].strip() else []), []
        elif line.startswith("&") and not body:
            terms.append(line[1:].strip())
        elif line.startswith("::"):
            continue
        elif line.startswith(":"):
            body.append(line[1:].strip())
        else:
            body.append(line)


def cedict_yaml(name: str, content: bytes):
    """List items of ``key: value`` lines; ``word`` heads, the rest is shown."""
    for block in re.split(r"(?m)^- ", decode_text(content)):
        fields: list[tuple[str, str]] = []
        for line in block.split("\n"):
            m = re.match(r"\s*(?:- )?([A-Za-z_]+):\s*(.*)$", line)
            if m:
                fields.append((m[1], m[2].strip(" \"'")))
            elif line.strip().startswith("- ") and fields:
                fields.append((fields[-1][0], line.strip()[2:].strip(" \"'")))
        words = [v for k, v in fields if k == "word" and v]
        if words:
            shown = "".join(f"<div><b>{html.escape(k)}</b>: {html.escape(v)}</div>" for k, v in fields if k not in ("word", "date") and v)
            yield entry(words, shown, "h")


def edlin(name: str, content: bytes):
    """A file per entry: links to its neighbours, its terms, its definition."""
    if name.endswith(".json"):
        return
    head, _, rest = decode_text(content).partition("\n")
    terms, _, defi = rest.partition("\n")
    yield entry(split_bar(terms), defi)


# --- Lingvo markup ---------------------------------------------------------------------------

# Markup tags and what they become.
DSL_TAGS = {"b": ("<b>", "</b>"), "i": ("<i>", "</i>"), "u": ("<u>", "</u>"), "sup": ("<sup>", "</sup>"), "sub": ("<sub>", "</sub>"), "c": ('<font color="green">', "</font>"), "p": ('<i class="p"><font color="green">', "</font></i>"),
            "ex": ('<span class="ex"><font color="steelblue">', "</font></span>"), "com": ("", ""), "*": ('<span class="sec">', "</span>"), "trn": ("", ""), "trs": ("", ""), "!trs": ("", ""), "!trn": ("", ""), "'": ('<u class="accent">', "</u>"), "lang": ("", ""), "t": ('<font face="Helvetica" class="dsl_t">', "</font>")}


_DSL_AUDIO, _DSL_IMAGE = (".wav", ".mp3"), (".bmp", ".gif", ".ico", ".jpeg", ".jpg", ".png", ".svg", ".tif", ".tiff", ".webp")
_DSL_PARTS = re.compile(
    r"\\(?P<kept>.)|\[m(?P<indent>\d*)\]|(?P<shut>\[/m\])|\[(?P<link>ref|url|s|video)(?: target=\"?(?P<target>[^\]\"]*)\"?)?[^\]]*\](?P<inner>.*?)\[/(?P=link)\]"
    r"|<<(?P<ref>.*?)>>|\[c (?P<color>[\w#]+)\]|\[(?P<end>/?)(?P<tag>b|i|u|sup|sub|c|p|ex|com|\*|trn|!trn|trs|!trs|'|lang|t)(?: [^\]]*)?\]"
    r"|(?P<joined>\n[ \t]*(?=\[m))|(?P<line>\n[ \t]*)|(?P<key>~)|(?P<text>[^\\\[<\n~]+|.)",
    re.S,
)


def _dsl_link(kind: str, inner: str, target: str | None) -> str:
    inner = re.sub(r"\\(.)", r"\1", inner)
    to, shown = target or inner, html.escape(inner, quote=False)
    if kind == "ref":
        return f"<a href={quoteattr('bword://' + to)}>{shown}</a>"
    if kind == "url":
        return f"<a href={quoteattr(to if '://' in to else 'http://' + to)}>{shown}</a>"
    if inner.lower().endswith(_DSL_AUDIO):
        return f'<object type="audio/x-wav" data="{inner}" width="40" height="40"><param name="autoplay" value="false" /></object>'
    return f'<img align="top" src="{inner}" alt="{inner}" />' if inner.lower().endswith(_DSL_IMAGE) else ""


def dsl_html(text: str, key: str = "") -> str:
    """Square-bracket markup as HTML; a backslash keeps the next character, ``~`` is the headword."""
    out: list[str] = []
    for m in _DSL_PARTS.finditer(re.sub(r"\{\{.*?\}\}", "", text, flags=re.S)):
        kind = m.lastgroup
        if kind == "kept":
            out.append(html.escape(m["kept"], quote=False))
        elif kind == "indent":
            out.append(f'<p style="padding-left:{m["indent"] if m["indent"].strip("0") else "0.3"}em;margin:0">')
        elif kind == "shut":
            out.append("</p>")
        elif m["link"]:
            out.append(_dsl_link(m["link"], m["inner"], m["target"]))
        elif kind == "ref":
            out.append(_dsl_link("ref", m["ref"], None))
        elif kind == "color":
            out.append(f'<font color="{m["color"]}">')
        elif m["tag"]:
            out.append(DSL_TAGS[m["tag"]][1 if m["end"] else 0])
        elif kind == "line":
            out.append("<br/>")
        elif kind == "key":
            out.append(html.escape(key, quote=False))
        elif kind == "text":
            out.append(html.escape(m["text"], quote=False))
    return "".join(out)


def dsl(name: str, content: bytes):
    """Headword lines, then an indented body; ``#`` lines head the file; ``@`` opens a sub-entry."""
    raw = content
    text = decode_text(raw) if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" not in raw[:200] else raw.decode("utf-16-le")
    terms: list[str] = []
    body: list[str] = []

    def clean(term: str) -> str:
        return re.sub(r"\\(.)", r"\1", re.sub(r"\{[^}]*\}", "", term)).strip()

    def flush():
        if not terms:
            return
        main, subs = [], []
        for line in body:
            if line.startswith("@"):
                if line[1:].strip():
                    subs.append((clean(line[1:]), []))
                    main.append(f"[ref]{clean(line[1:])}[/ref]")
                else:
                    subs.append((None, []))
            elif subs and subs[-1][0] is not None:
                subs[-1][1].append(line)
            else:
                main.append(line)
        yield entry([clean(t) for t in terms], dsl_html("\n".join(main), clean(terms[0])), "h")
        for title, lines in subs:
            if title:
                yield entry(title, dsl_html("\n".join(lines), title), "h")

    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith("#"):
            key, _, value = line[1:].partition(" ")
            yield info({"NAME": "name", "INDEX_LANGUAGE": "sourceLang", "CONTENTS_LANGUAGE": "targetLang"}.get(key, key), value.strip().strip('"'))
        elif not line.strip():
            continue
        elif line[0] in " \t":
            body.append(line.strip())
        else:
            if body:
                yield from flush()
                terms, body = [], []
            terms.append(line.strip())
    yield from flush()


# --- XML families ----------------------------------------------------------------------------


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _elements(content: bytes, *names: str):
    """Finished elements of these names, each freed after use."""
    stack: list = []
    for event, node in ET.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            stack.append(node)
            continue
        stack.pop()
        if _local(node.tag) in names and not any(_local(x.tag) in names for x in stack):
            yield node
            node.clear()
            if stack:
                stack[-1].remove(node)


def _all(node, name: str):
    return [x for x in node.iter() if _local(x.tag) == name]


def _kids(node, name: str):
    return [x for x in node if _local(x.tag) == name]


def _text(node) -> str:
    return "".join(node.itertext()).strip() if node is not None else ""


def tmx(name: str, content: bytes):
    """Translation units: the first language's text is the term, the second the definition."""
    for unit in _elements(content, "tu"):
        both = [(tuv.get("{http://www.w3.org/XML/1998/namespace}lang") or tuv.get("lang"), _text((_kids(tuv, "seg") or [None])[0])) for tuv in _kids(unit, "tuv")]
        if len(both) >= 2 and both[0][1] and both[1][1]:
            notes = "".join(f"\n{p.get('type')}: {_text(p)}" for p in _kids(unit, "prop"))
            yield info("sourceLang", both[0][0] or "")
            yield info("targetLang", both[1][0] or "")
            yield entry(both[0][1], both[1][1] + notes)


def xliff(name: str, content: bytes):
    """trans-unit (any namespace) with both texts."""
    for unit in _elements(content, "trans-unit", "segment"):
        source, target = (_text((_kids(unit, k) or [None])[0]) for k in ("source", "target"))
        if source and target:
            note = "".join("\n" + _text(n) for n in _kids(unit, "note"))
            yield entry(source, target + note)


def _joined(parts: list[tuple[str, str]]) -> tuple[str, str]:
    """One definition of several typed parts."""
    if len(parts) == 1:
        return parts[0][1], parts[0][0]
    kinds = {k for k, _ in parts}
    if len(kinds) == 1:
        kind = kinds.pop()
        return ("\n<hr>" if kind == "h" else "\n").join(t for _, t in parts), kind
    shown = [f"<pre>{t}</pre>" if k == "m" else xdxf_html(t) if k == "x" else t for k, t in parts]
    return "\n<hr>\n".join(shown), "h"


def stardict_textual(name: str, content: bytes):
    """``article`` with key, synonyms and typed definitions."""
    for node in _elements(content, "info", "article"):
        if _local(node.tag) == "info":
            for child in node:
                yield info({"bookname": "name"}.get(_local(child.tag), _local(child.tag)), _text(child))
            continue
        terms = [_text(x) for x in [*_kids(node, "key"), *_kids(node, "synonym")]]
        parts = [({"h": "h", "x": "x"}.get(d.get("type", "m"), "m"), _text(d)) for d in _kids(node, "definition")]
        if terms and parts:
            yield entry(terms, *_joined(parts))


# Article tags and what they become.
XDXF_TAGS = {"k": ("<b>", "</b>"), "b": ("<b>", "</b>"), "i": ("<i>", "</i>"), "sub": ("<sub>", "</sub>"), "sup": ("<sup>", "</sup>"), "tt": ("<tt>", "</tt>"), "big": ("<big>", "</big>"), "small": ("<small>", "</small>"), "blockquote": ("<p>&#160;&#160;&#160;", "</p>"),
             "tr": ("[", "]"), "ex": ('<div class="example" style="padding: 10px 0px 10px 10px;"><font color="steelblue">', "</font></div>"), "gr": ('<font color="green">', "</font>"), "pos": ('<font color="green">', "</font>"), "abr": ('<i><font color="green">', "</font></i>"), "abbr": ('<i><font color="green">', "</font></i>"),
             "dtrn": ('<span class="dtrn">', "</span>"), "co": ("(", ")"), "def": ("<div>", "</div>"), "c": None, "kref": None, "iref": None, "rref": None}


def _xdxf_node(node) -> str:
    inner = html.escape(node.text or "", quote=False) + "".join(_xdxf_node(c) + html.escape(c.tail or "", quote=False) for c in node)
    tag = _local(node.tag)
    if tag == "kref":
        target = html.escape(node.get("k") or "".join(node.itertext()))
        return f'<a class="kref" href="bword://{target}">{inner}</a>'
    if tag == "iref":
        return f'<a class="iref" href="{html.escape(node.get("href") or _text(node))}">{inner}</a>'
    if tag == "rref":
        src = html.escape(_text(node))
        return f'<audio src="{src}" controls></audio>' if src.lower().endswith((".wav", ".mp3", ".ogg", ".spx")) else f'<img src="{src}" />'
    if tag == "c":
        return f'<font color="{html.escape(node.get("c") or "green")}">{inner}</font>'
    opening, closing = XDXF_TAGS.get(tag) or ("", "")
    return opening + inner + closing


def xdxf_html(text: str) -> str:
    """XDXF article content as HTML; what isn't well-formed stays."""
    try:
        return _xdxf_node(ET.fromstring(f"<ar>{text}</ar>")).replace("\n", "<br/>")
    except ET.ParseError:
        return text


def _optional(node) -> list[str]:
    """All readings of a key with optional parts."""
    readings = [node.text or ""]
    for child in node:
        options = _optional(child)
        if _local(child.tag) == "opt":
            options = ["", *options]
        elif _local(child.tag) == "nu":
            options = [""]
        readings = [r + o + (child.tail or "") for r in readings for o in options]
    return readings


def xdxf(name: str, content: bytes, as_html: bool = True):
    """``ar`` with keys (all optional readings) and its content."""
    for node in _elements(content, "full_name", "full_title", "description", "ar"):
        if _local(node.tag) != "ar":
            yield info({"full_name": "name", "full_title": "name"}.get(_local(node.tag), _local(node.tag)), _text(node))
            continue
        terms = list(dict.fromkeys(" ".join(t.split()) for k in _all(node, "k") for t in reversed(_optional(k)) if t.strip()))
        for k in _kids(node, "k"):
            k.tail = (k.tail or "").lstrip()
        inner = (node.text or "").lstrip() + "".join(ET.tostring(c, "unicode") for c in node)
        if terms:
            yield entry(terms, xdxf_html(inner), "h") if as_html else entry(terms, inner.strip(), "x")


def xdxf_lax(name: str, content: bytes):
    """The same from text that isn't well-formed: articles are cut out one by one."""
    text = decode_text(content)
    for m in re.finditer(r"(?is)<ar\b[^>]*>(.*?)</ar>", text):
        terms = [html.unescape(re.sub(r"<[^>]*>", "", k)).strip() for k in re.findall(r"(?is)<k\b[^>]*>(.*?)</k>", m[1])]
        if terms:
            yield entry(terms, xdxf_html(m[1].strip()), "h")


def freedict(name: str, content: bytes, markdown: bool = False):
    """TEI entries: plain forms, then inflected ones; pronunciation, grammar, senses."""
    for node in _elements(content, "titleStmt", "entry"):
        if _local(node.tag) == "titleStmt":
            yield info("name", _text((_all(node, "title") or [None])[0]))
            continue
        plain, inflected = [], []
        for form in _all(node, "form"):
            (inflected if form.get("type") == "infl" else plain).extend(_text(o) for o in _kids(form, "orth"))
        terms = list(dict.fromkeys(t for t in plain + inflected if t))
        if not terms:
            continue
        pron = [_text(p).strip("/") for p in _all(node, "pron")]
        grammar = [_text(g) for group in _all(node, "gramGrp") for g in group if _text(g)]
        senses = []
        for sense in _all(node, "sense"):
            quotes = [_text(q) for cit in _kids(sense, "cit") if cit.get("type") in ("trans", "translation") for q in _all(cit, "quote")]
            definitions = [_text(d) for d in _kids(sense, "def")]
            examples = [_text(q) for cit in _kids(sense, "cit") if cit.get("type") == "example" for q in _kids(cit, "quote")]
            if quotes or definitions:
                senses.append(("; ".join(quotes + definitions), examples))
        if markdown:
            lines = ([f"**{terms[0]}**" + (f" /{', '.join(pron)}/" if pron else "")]) + ([f"*{', '.join(grammar)}*"] if grammar else []) + [f"{k}. {s}" + "".join(f"\n   - {e}" for e in ex) for k, (s, ex) in enumerate(senses, 1)]
            yield entry(terms, "\n".join(lines))
            continue
        shown = [html.escape(s) + "".join(f'<div class="example">{html.escape(e)}</div>' for e in ex) for s, ex in senses]
        body = "<ol>" + "".join(f"<li>{s}</li>" for s in shown) + "</ol>" if len(shown) > 1 else "".join(shown)
        head = (f"/{html.escape(', '.join(pron))}/<br/>" if pron else "") + (f"<i>{html.escape(', '.join(grammar))}</i><br/>" if grammar else "")
        yield entry(terms, head + body, "h")


def _jm_terms(node) -> tuple[list[str], list[str], list[str]]:
    kanji, readings, terms = [], [], []
    for k in _kids(node, "k_ele"):
        raw = _text((_kids(k, "keb") or [None])[0])
        norm = unicodedata.normalize("NFKC", raw)
        kanji.append(norm)
        terms += [norm] + [raw] * (raw != norm)
    for r in _kids(node, "r_ele"):
        readings.append(_text((_kids(r, "reb") or [None])[0]))
    terms += readings + [f"{k}・{r}" for k in kanji for r in readings]
    return list(dict.fromkeys(t for t in terms if t)), kanji, readings


def jmdict(name: str, content: bytes):
    """Kanji, readings and their products as terms; senses with their marks."""
    for node in _elements(content, "entry"):
        terms, kanji, readings = _jm_terms(node)
        senses = []
        for s in [*_kids(node, "sense"), *_kids(node, "trans")]:
            marks = [_text(x) for x in s if _local(x.tag) in ("pos", "misc", "field", "dial", "name_type") and _text(x)]
            glosses = [_text(x) for x in s if _local(x.tag) in ("gloss", "trans_det") and _text(x)]
            see = [_text(x) for x in _kids(s, "xref")]
            senses.append((f"<i>{html.escape(', '.join(marks))}</i> " if marks else "") + html.escape("; ".join(glosses)) + "".join(f' <a href="bword://{html.escape(x)}">{html.escape(x)}</a>' for x in see))
        head = "".join(f"<div>{html.escape(x)}</div>" for x in kanji[1:] + readings)
        if terms and senses:
            yield entry(terms, head + ("<ol>" + "".join(f"<li>{s}</li>" for s in senses) + "</ol>" if len(senses) > 1 else senses[0]), "h")


def apple_source(name: str, content: bytes):
    """``d:entry`` with ``d:index`` variants."""
    for node in _elements(content, "entry"):
        titles = [x.get("{http://www.apple.com/DTDs/DictionaryService-1.0.rng}value", "") for x in _kids(node, "index")]
        body = "".join(ET.tostring(c, "unicode") for c in node if _local(c.tag) != "index")
        terms = list(dict.fromkeys([node.get("{http://www.apple.com/DTDs/DictionaryService-1.0.rng}title", ""), *titles]))
        if any(terms):
            yield entry([t for t in terms if t], body.strip(), "h")


# --- SQLite ----------------------------------------------------------------------------------


def _database(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    con.text_factory = lambda b: b.decode("utf-8", "ignore")
    return con


def almaany(name: str, content: bytes):
    con = _database(content)
    alts = defaultdict(list)
    for word, key in con.execute("select wordkey, searchwordkey from Keys"):
        alts[word].append(key)
    for word, meaning, root in con.execute("select word, meaning, root from WordsTable order by id"):
        body = (meaning or "").replace("|", "<br>") + (f'<br>Root: <a href="bword://{root}">{root}</a>' if root else "")
        yield entry(list(dict.fromkeys([word, *alts[word]])), f'<div dir="rtl">{body}</div>', "h")


def dict_cc(name: str, content: bytes):
    """Both directions, grouped by headword."""
    con = _database(content)
    for term, other in (("term1", "term2"), ("term2", "term1")):
        rows = con.execute(f"select {term}, {other}, entry_type from main_ft order by {term}")
        for word, group in groupby(rows, key=lambda r: r[0]):
            items = [(o, t) for _, o, t in group]
            bare = re.sub(r"\s*[{\[<][^}\]>]*[}\]>]", "", word or "").strip() or word
            yield entry(list(dict.fromkeys([bare, word])), "<ul>" + "".join(f"<li>{html.escape(o)}{f' <i>{html.escape(t)}</i>' if t else ''}</li>" for o, t in items) + "</ul>", "h")


def dict_cc_split(name: str, content: bytes):
    con = _database(content)
    for term, other in (("term1", "term2"), ("term2", "term1")):
        for word, text, kind in con.execute(f"select {term}, {other}, entry_type from main_ft order by rowid"):
            yield entry(f"{word} {{{kind}}}" if kind else word, text)


def ayandict_sqlite(name: str, content: bytes):
    con = _database(content)
    for key, value in con.execute("select key, value from meta"):
        yield info(key, value)
    alts = defaultdict(list)
    for number, term in con.execute("select id, term from alt order by rowid"):
        alts[number].append(term)
    for number, term, article in con.execute("select id, term, article from entry order by id"):
        yield entry([term, *alts[number]], article, "h")


def anki(name: str, content: bytes, word_field: int = 1, include_tags: bool = False):
    """A zip with a SQLite collection: one field is the term, the others the definition."""
    z = zipfile.ZipFile(io.BytesIO(content))
    base = next(n for n in ("collection.anki21", "collection.anki2") if n in z.namelist())
    for fields, tags in _database(z.read(base)).execute("select flds, tags from notes order by id"):
        cells = fields.split("\x1f")
        if len(cells) >= word_field:
            rest = [c for k, c in enumerate(cells) if k != word_field - 1 and c]
            if include_tags and tags and tags.strip():
                rest.append("Tags: " + ", ".join(tags.split()))
            yield entry(re.sub(r"<[^>]*>", "", cells[word_field - 1]).strip(), "<br>".join(rest), "h")


def digitalnk(name: str, content: bytes):
    for word, text in _database(content).execute("select word, definition from dictionary order by word"):
        yield entry(html.unescape(word), text, "h")


def makindo(name: str, content: bytes):
    for title, text in _database(content).execute("select title, definition from NEW_TABLE where _id is not null"):
        yield entry(title if isinstance(title, str) else title.decode("utf-8", "ignore"), text if isinstance(text, str) else text.decode("utf-8", "ignore"), "h")


def wordset_order(path: str) -> tuple[bool, str]:
    """Files by name, ``misc`` last."""
    stem = path.rpartition("/")[2].rpartition(".")[0]
    return stem == "misc", stem


def wordset(name: str, content: bytes):
    """JSON object: word -> meanings."""
    for word, record in sorted(json.loads(content).items(), key=lambda kv: kv[0].lower().encode()):
        meanings = record.get("meanings") or []
        shown = "".join(f"<li><i>{html.escape(m.get('speech_part') or '')}</i> {html.escape(m.get('def') or '')}" + (f"<div class='example'>{html.escape(m['example'])}</div>" if m.get("example") else "") + "</li>" for m in meanings)
        yield entry(word, f"<ol>{shown}</ol>", "h")


# --- archives ----------------------------------------------------------------------------------


def structured_html(node) -> str:
    """Structured content (nested JSON) as HTML."""
    if node is None:
        return ""
    if isinstance(node, str):
        return html.escape(node).replace("\n", "<br/>")
    if isinstance(node, list):
        return "".join(map(structured_html, node))
    if node.get("type") == "structured-content":
        return structured_html(node.get("content"))
    if node.get("type") == "text":
        return html.escape(node.get("text", ""))
    if node.get("type") == "image" or node.get("tag") == "img":
        return f'<img src="{html.escape(node.get("path", ""))}" />'
    tag = node.get("tag", "span")
    if tag == "br":
        return "<br/>"
    target = f' href="{html.escape(node["href"])}"' if node.get("href") else ""
    return f"<{tag}{target}>{structured_html(node.get('content'))}</{tag}>"


def yomichan(name: str, content: bytes):
    """Numbered term banks; entries that name lemmas attach to them, lemmas without an entry get one."""
    z = zipfile.ZipFile(io.BytesIO(content))
    index = json.loads(z.read("index.json"))
    yield info("name", str(index.get("title", "")))
    for key in ("author", "description", "url", "attribution"):
        if index.get(key):
            yield info(key, str(index[key]))
    banks = sorted((n for n in z.namelist() if re.fullmatch(r"term_bank_\d+\.json", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    rows, forms = [], defaultdict(list)
    for bank in banks:
        for term, reading, _, _, _, definitions, *_ in json.loads(z.read(bank)):
            lemmas = [d[0] for d in definitions if isinstance(d, list) and d]
            if lemmas:
                for lemma in lemmas:
                    forms[lemma].append(term)
                continue
            rows.append((term, reading, definitions))
    seen = set()
    for term, reading, definitions in rows:
        seen.add(term)
        yield entry(list(dict.fromkeys([term, *([reading] if reading else []), *forms.get(term, [])])), "".join(f"<div>{structured_html(d)}</div>" for d in definitions), "h")
    for lemma in sorted(set(forms) - seen):
        yield entry(list(dict.fromkeys([lemma, *forms[lemma]])), f'<a href="bword://{html.escape(lemma)}">{html.escape(lemma)}</a>', "h")
    for n in z.namelist():
        if not n.endswith((".json", "/")):
            yield resource(n, z.read(n))


# --- multi-file binary dictionaries: the files of one dictionary come together -----------------


def stardict(files: dict[str, bytes]):
    """ifo, idx, dict and syn: entries with typed parts."""
    ifo = dict(line.split("=", 1) for line in decode_text(files["ifo"]).splitlines() if "=" in line)
    bits = ifo.get("idxoffsetbits", "32")
    if bits not in ("32", "64"):
        raise ValueError(f"idxoffsetbits is {bits}")
    for key, value in ifo.items():
        if key not in ("version", "wordcount", "idxfilesize", "synwordcount", "sametypesequence", "idxoffsetbits"):
            yield info({"bookname": "name"}.get(key, key), value)
    idx, body, form = files["idx"], files["dict"], ">QI" if bits == "64" else ">II"
    size = struct.calcsize(form)
    alts, at, syn = defaultdict(list), 0, files.get("syn", b"")
    while (end := syn.find(b"\0", at)) >= 0 and end + 5 <= len(syn):
        alts[struct.unpack_from(">I", syn, end + 1)[0]].append(syn[at:end].decode("utf-8", "replace"))
        at = end + 5
    at = number = 0
    while (end := idx.find(b"\0", at)) >= 0 and end + 1 + size <= len(idx):
        start, length = struct.unpack_from(form, idx, end + 1)
        parts = _typed_parts(body[start : start + length], ifo.get("sametypesequence", "").strip("-"))
        if parts:
            yield entry([idx[at:end].decode("utf-8", "replace"), *alts[number]], *_joined(parts))
        at, number = end + 1 + size, number + 1


# Definition types of the container and what they are here.
STARDICT_TYPES = {"m": "m", "t": "m", "y": "m", "g": "h", "h": "h", "x": "x"}


def _typed_parts(block: bytes, types: str) -> list[tuple[str, str]]:
    """Lower-case parts end with a NUL, upper-case ones start with their size; with given types the last is bare."""
    parts, at, given = [], 0, list(types)
    compact = bool(types)
    while given if compact else at < len(block):
        kind = given.pop(0) if compact else chr(block[at])
        at += not compact
        if compact and not given:
            raw, at = block[at:], len(block)
        elif kind.isupper():
            n = struct.unpack_from(">I", block, at)[0]
            raw, at = block[at + 4 : at + 4 + n], at + 4 + n
        else:
            end = block.find(b"\0", at)
            end = len(block) if end < 0 else end
            raw, at = block[at:end], end + 1
        if kind in STARDICT_TYPES:
            parts.append((STARDICT_TYPES[kind], raw.decode("utf-8", "replace")))
        elif kind == "r":
            parts.append(("h", "".join(f'<img src="{n.partition(":")[2]}" />' if n.startswith("img:") else f'<a href="{n.partition(":")[2]}">{n}</a>' for n in raw.decode("utf-8", "replace").split("\n") if n)))
    return parts


B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def b64_number(text: str) -> int:
    n = 0
    for c in text:
        n = n << 6 | B64.index(c)
    return n


def number_b64(n: int) -> str:
    out = B64[n & 63]
    while n := n >> 6:
        out = B64[n & 63] + out
    return out


def dictd(files: dict[str, bytes]):
    """index (word, offset, size in base 64) and data; a word's articles are joined."""
    words: dict[str, list[tuple[int, int]]] = {}
    for line in decode_text(files["index"]).splitlines():
        cells = line.split("\t")
        if len(cells) >= 3:
            words.setdefault(cells[0], []).append((b64_number(cells[1]), b64_number(cells[2])))
    for word, places in words.items():
        texts = [files["dict"][s : s + n].decode("utf-8", "replace").strip() for s, n in places]
        if word.startswith("00-database-") or word.startswith("00database"):
            yield info(word.removeprefix("00-database-").removeprefix("00database"), texts[0])
            continue
        texts = [re.sub(r"\{([^{}]*)\}", r'<a href="bword://\1">\1</a>', t) for t in texts]
        kind = "h" if any("<a " in t or "<br" in t for t in texts) else "m"
        yield entry(word, "\n\n<hr>\n\n".join(texts), kind)


def wordnet(files: dict[str, bytes]):
    """data.* synsets; words collect their synsets, pointers resolve by file and offset."""
    synsets: dict[tuple[str, int], tuple[list[str], str, list]] = {}
    for name in sorted(files):
        for line in decode_text(files[name]).splitlines():
            if not line or line.startswith("  "):
                continue
            head, _, gloss = line.partition("|")
            f = head.split()
            n = int(f[3], 16)
            words = [w.replace("_", " ") for w in f[4 : 4 + 2 * n : 2]]
            at = 4 + 2 * n
            pointers = [(f[at + 1 + 4 * k], f[at + 3 + 4 * k], int(f[at + 2 + 4 * k])) for k in range(int(f[at]))]
            synsets[f[2].replace("s", "a"), int(f[0])] = (words, gloss.strip(), pointers)
    articles = defaultdict(list)
    for (pos, _), (words, gloss, pointers) in synsets.items():
        links = [w for _, p, offset in pointers for w in synsets.get((p.replace("s", "a"), offset), ([], "", []))[0]]
        for word in words:
            others = [w for w in words if w != word]
            articles[word].append(f"<i>{pos}</i> {html.escape(gloss)}" + (f"<br/><small>Synonyms: {html.escape(', '.join(others))}</small>" if others else "") + "".join(f' <a href="bword://{html.escape(w)}">{html.escape(w)}</a>' for w in links))
    for word, texts in articles.items():
        yield entry(word, texts[0] if len(texts) == 1 else "<ol>" + "".join(f"<li>{t}</li>" for t in texts) + "</ol>", "h")


def dicformids(files: dict[str, bytes]):
    """directory*.csv: term TAB definition lines."""
    for name in sorted((n for n in files if re.search(r"directory\d+\.csv$", n)), key=lambda n: int(re.findall(r"(\d+)\.csv", n)[-1])):
        for line in decode_text(files[name]).splitlines():
            term, tab, defi = line.partition("\t")
            if tab:
                yield entry([re.sub(r"\[\d\d.*?\]", "", t).strip() for t in term.split(";")], re.sub(r"\[\d\d(.*?)\]", r"\1", defi).replace("\\n", "\n"))
