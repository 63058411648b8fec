"""License scans: Aho-Corasick finds notice phrases and identifier tags in one pass, a shunting-yard parser reads the
licence expressions after tags.

Notice phrases are looked for in the sequence of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, so
punctuation and line breaks inside a phrase don't matter. The base phrases give counted places; further phrases and tags
give labels only. An expression (`MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)`) is read up to the end of its line
as far as it parses, brought to postfix form, and evaluated to how freely the text may be used: `or` takes the best of
two, `and` the worst, `with` and a listed exception lifts its licence half of the way to free. A document's score is the
worst over all its notices and expressions, and 0.5 without any.

Edge cases. Null and empty texts have no words, places or labels, null first and last word, score 0.5. A tag without a
readable expression gives no label; an unlisted identifier in one gives `unknown` after the tag that is used for nothing
else, and none after the others. Nesting needs no recursion, so any depth will do. Repeated rows, ties and null ids are
rows like others; an empty table gives an empty result. Other columns are never read. Ids are whole numbers, or texts of
such; others are an error. Scans take time in proportion to the text, however many hits it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import portions
from corpusgraph.llm.decontaminate import WORD_TABLE

# Phrases with places, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further phrases, label only.
MORE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "bsd 3 clause license": "bsd-3",
    "bsd 2 clause license": "bsd-2",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
}
# How freely a labelled text may be used, from 0 to 1.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd-2": 1.0, "bsd-3": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "mpl-2": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
# Families of identifiers in expressions, lower-cased: stem, label, versions, endings.
FAMILIES = (
    ("gpl", "gpl-{major}", ("1.0", "2.0", "3.0"), ("", "-only", "-or-later")),
    ("agpl", "agpl-{major}", ("1.0", "3.0"), ("", "-only", "-or-later")),
    ("lgpl", "lgpl", ("2.0", "2.1", "3.0"), ("", "-only", "-or-later")),
    ("gfdl", "gfdl", ("1.1", "1.2", "1.3"), ("", "-only", "-or-later")),
    ("mpl", "mpl-{major}", ("1.0", "1.1", "2.0"), ("",)),
    ("apache", "apache-{major}", ("1.0", "1.1", "2.0"), ("",)),
    ("epl", "epl", ("1.0", "2.0"), ("",)),
    ("eupl", "eupl", ("1.0", "1.1", "1.2"), ("",)),
    ("cddl", "cddl", ("1.0", "1.1"), ("",)),
    ("osl", "osl", ("1.0", "2.0", "2.1", "3.0"), ("",)),
    ("afl", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0"), ("",)),
    ("artistic", "artistic", ("1.0", "2.0"), ("",)),
    ("cc-by", "cc-by", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-sa", "cc-by-sa", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nd", "cc-by-nd", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nc", "cc-by-nc", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nc-sa", "cc-by-nc", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("cc-by-nc-nd", "cc-by-nc", ("1.0", "2.0", "2.5", "3.0", "4.0"), ("",)),
    ("ofl", "ofl", ("1.0", "1.1"), ("",)),
    ("python", "psf", ("2.0",), ("",)),
    ("zpl", "zpl", ("2.0", "2.1"), ("",)),
    ("odc-by", "odc-by", ("1.0",), ("",)),
    ("odbl", "odbl", ("1.0",), ("",)),
    ("busl", "busl", ("1.1",), ("",)),
    ("sspl", "sspl", ("1.0",), ("",)),
)
# Identifiers that belong to no family.
SINGLE_IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit", "x11": "mit", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "bsd-4-clause": "bsd-4", "0bsd": "0bsd", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "cc0-1.0": "cc0", "cc-pddc": "public-domain",
    "wtfpl": "wtfpl", "bsl-1.0": "boost", "ncsa": "ncsa", "psf-2.0": "psf", "ruby": "ruby", "vim": "vim", "openssl": "openssl", "postgresql": "postgresql", "unicode-dfs-2016": "unicode", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "elastic-2.0": "elastic",
    "pddl-1.0": "public-domain", "upl-1.0": "upl", "blueoak-1.0.0": "blueoak", "mulanpsl-2.0": "mulan", "curl": "curl", "libpng-2.0": "libpng", "ecl-2.0": "ecl", "ftl": "ftl", "ijg": "ijg", "w3c": "w3c",
}
# Exceptions that lift a licence's duties for some use.
EXCEPTIONS = frozenset(
    "389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 ecos-exception-2.0 fawkes-runtime-exception fltk-exception font-exception-2.0 freertos-exception-2.0 "
    "gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception gpl-3.0-linking-exception gpl-cc-1.0 i2p-gpl-java-exception lgpl-3.0-linking-exception libtool-exception linux-syscall-note llvm-exception mif-exception ocaml-lgpl-linking-exception "
    "openjdk-assembly-exception-1.0 openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1 x11vnc-openssl-exception".split()
)
# How freely a text under one of the further labels may be used.
FREEDOM |= {
    "apache-1": 0.9, "bsd-4": 0.9, "0bsd": 1.0, "wtfpl": 1.0, "boost": 1.0, "ncsa": 1.0, "psf": 1.0, "ruby": 0.8, "vim": 0.8, "openssl": 0.9, "postgresql": 1.0, "unicode": 1.0, "ms-pl": 0.8, "ms-rl": 0.6, "elastic": 0.2, "upl": 1.0, "blueoak": 1.0, "mulan": 1.0,
    "curl": 1.0, "libpng": 1.0, "ecl": 1.0, "ftl": 0.9, "ijg": 1.0, "w3c": 1.0, "mpl-1": 0.7, "eupl": 0.5, "cddl": 0.6, "osl": 0.5, "afl": 0.9, "artistic": 0.8, "cc-by-nd": 0.3, "ofl": 0.9, "zpl": 1.0, "odc-by": 0.9, "odbl": 0.6, "busl": 0.2, "sspl": 0.2,
    "gpl-1": 0.4, "agpl-1": 0.3, "gfdl": 0.5, "unknown": 0.5,
}
# Tags before an expression. After the first an unlisted identifier counts as `unknown`; the others are also
# found in prose, where only a listed identifier makes a label.
SURE_TAG = "spdx-license-identifier:"
TAGS = (SURE_TAG, "license-expression:", "license:", "licence:", '"license":', 'license =', "license=")
BINDS = {"or": 1, "and": 2, "with": 3}
UNKNOWN = 0.5
_TOKEN = re.compile(r"[ \t\"']*([()]|[A-Za-z0-9.+-]+)")


def identifiers() -> dict[str, str]:
    """Identifiers of expressions and the label each stands for."""
    out = dict(SINGLE_IDENTIFIERS)
    for stem, label, versions, endings in FAMILIES:
        for v in versions:
            for e in endings:
                out[f"{stem}-{v}{e}"] = label.format(major=v[0])
    return out


IDENTIFIERS = identifiers()


def tokens(text: str, at: int) -> Iterator[str]:
    while m := _TOKEN.match(text, at):
        yield m[1]
        at = m.end()


def postfix(expression: Iterator[str]) -> list[str]:
    """Shunting-yard: the longest prefix of the tokens that is a whole expression, in postfix order."""
    out: list[str] = []
    waiting: list[str] = []
    best: list[str] = []
    want_operand = True
    depth = 0
    for token in expression:
        word = token.lower()
        if token == "(" and want_operand:
            waiting.append(token)
            depth += 1
        elif token == ")" and not want_operand and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif word in BINDS and not want_operand:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            want_operand = True
            continue
        elif token not in "()" and word not in BINDS and want_operand:
            out.append(word)
            want_operand = False
        else:
            break
        if not want_operand and not depth:
            best = [*out, *reversed(waiting)]
    return best


def evaluate(code: list[str]) -> tuple[float | None, list[str]]:
    """Freedom of a postfix expression (None if it is empty) and the labels of its licences, `unknown` for unlisted ones."""
    stack: list[float] = []
    labels: list[str] = []
    for i, token in enumerate(code):
        if token in BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "or" else min(a, b) if token == "and" else max(a, (1 + a) / 2 * b))
        elif i + 1 < len(code) and code[i + 1] == "with":
            stack.append(float(token in EXCEPTIONS))  # an exception's name: an unlisted one lifts nothing
        else:
            label = IDENTIFIERS.get(token.rstrip("+"), "unknown")
            labels.append(label)
            stack.append(FREEDOM[label])
    return (stack[0] if stack else None), labels


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | MORE_PHRASES).items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


def tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, tag)
    found.make_automaton()
    return found


def scan_text(body: bytes, phrases: ahocorasick.Automaton, tags: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text in UTF-8."""
    words = body.translate(WORD_TABLE).split()
    line = " " + b" ".join(words).decode() + " "
    n_places, first, last, base, labels = 0, None, None, set(), set()
    word, upto = 0, 0  # words that begin before a place of the line
    for start, label, counted in sorted((end + 1 - size, label, counted) for end, (size, label, counted) in phrases.iter(line)):
        labels.add(label)
        if counted:
            word, upto = word + line.count(" ", upto, start), start
            first, last = (word if first is None else first), word
            n_places += 1
            base.add(label)
    freedoms = [FREEDOM[x] for x in labels]
    low = body.lower()
    if b"licen" in low:
        text = low.decode()
        for end, tag in tags.iter(text):
            freedom, found = evaluate(postfix(tokens(text, end + 1)))
            if found and (tag == SURE_TAG or "unknown" not in found):
                labels.update(found)
                freedoms.append(freedom)
    return len(words), n_places, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(freedoms, default=0.5)


SCHEMA = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases, tags = automaton(), tag_automaton()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for batch in portions(batches, "text"):
        rows = [scan_text(t.as_py() or b"", phrases, tags) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]], names)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scan, SCHEMA)
    return out.withColumnRenamed("id", id_col)
