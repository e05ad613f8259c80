"""License scans: templates with optional and replaceable regions as token automata.

Markup of a template:

    <<beginOptional>> words <<endOptional>>          may be left out, may be nested
    <<var;name="x";original="...";match="PATTERN">>  replaceable; PATTERN is .+ (one or more
                                                     words), .* (any words), .{m,n} (m to n
                                                     words) or literal alternatives such as
                                                     "a copy|copies"

Everything else is mandatory wording and has to stand in the text word by word. Words are
runs of letters, digits and non-ASCII characters; case of A-Z, punctuation and white space
don't count. Of literal alternatives the shortest counts as mandatory wording, of free regions
nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake.llm.common import arrow_map, text_bytes

# UTF-8 bytes: A-Z to a-z, other bytes outside words to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A
              else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))

_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^<>]*?)?)>>")
_MATCH = re.compile(r';match="([^"]*)"')
_RANGE = re.compile(r"\.\{(\d+),(\d+)\}")


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


@dataclass
class Template:
    """A label and the markup of its wording; `phrase` templates are the base phrases."""

    label: str
    markup: str
    phrase: bool = False


@dataclass
class Automaton:
    """Word automaton of several templates, searched at every place of a text at once.

    edges[s] are (word, target) pairs, word None standing for any; empty[s] are targets
    without a word. Sets of states become states of a table on demand; the table is thrown
    away when it grows beyond `limit`, which costs time and nothing else.
    """

    templates: list[Template]
    limit: int = 20_000
    edges: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    accepts: dict[int, int] = field(default_factory=dict)
    mandatory: list[int] = field(default_factory=list)
    phrase_words: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.root = self._state()
        for number, template in enumerate(self.templates):
            start = self._state()
            self.empty[self.root].append(start)
            end = self._compile(template.markup, start)
            self.accepts[end] = number
        self._reset()

    def _state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _wording(self, state: int, text: str) -> tuple[int, int]:
        found = words(text.encode())
        for word in found:
            target = self._state()
            self.edges[state].append((word, target))
            state = target
        return state, len(found)

    def _compile(self, markup: str, state: int) -> int:
        optional: list[int] = []
        mandatory, at = 0, 0
        for mark in [*_MARK.finditer(markup), None]:
            text = markup[at:mark.start() if mark else len(markup)]
            state, count = self._wording(state, text)
            mandatory += 0 if optional else count
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                optional.append(state)
                inner = self._state()
                self.empty[state].append(inner)
                state = inner
            elif mark[1] == "endOptional":
                if not optional:
                    raise ValueError("endOptional without beginOptional")
                outer = self._state()
                self.empty[state].append(outer)
                self.empty[optional.pop()].append(outer)
                state = outer
            else:
                state, count = self._replaceable(state, (_MATCH.search(mark[2]) or [0, ".+"])[1])
                mandatory += 0 if optional else count
        if optional:
            raise ValueError("beginOptional without endOptional")
        if not mandatory:
            raise ValueError("a template needs mandatory wording")
        self.mandatory.append(mandatory)
        self.phrase_words.append(mandatory)
        return state

    def _replaceable(self, state: int, match: str) -> tuple[int, int]:
        end = self._state()
        if match in (".+", ".*"):
            self.edges[state].append((None, end))
            self.edges[end].append((None, end))
            if match == ".*":
                self.empty[state].append(end)
            return end, 0
        if bounds := _RANGE.fullmatch(match):
            least, most = int(bounds[1]), int(bounds[2])
            if least > most:
                raise ValueError(f"no number of words fits {match}")
            for number in range(most + 1):
                if number >= least:
                    self.empty[state].append(end)
                if number < most:
                    step = self._state()
                    self.edges[state].append((None, step))
                    state = step
            return end, 0
        counts = []
        for option in match.split("|"):
            last, count = self._wording(state, option)
            self.empty[last].append(end)
            counts.append(count)
        return end, min(counts)

    def _reset(self):
        self._rows: list[dict[bytes, int]] = []
        self._sets: list[frozenset[int]] = []
        self._hits: list[tuple[int, ...]] = []
        self._number: dict[frozenset[int], int] = {}
        self._closed([self.root])

    def _closed(self, states) -> int:
        """Table row of the states reachable without a word, the root among them."""
        todo, seen = [*states, self.root], set()
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.empty[s]
        key = frozenset(seen)
        if key not in self._number:
            self._number[key] = len(self._sets)
            self._sets.append(key)
            self._rows.append({})
            self._hits.append(tuple(sorted(self.accepts[s] for s in key if s in self.accepts)))
        return self._number[key]

    def _step(self, row: int, word: bytes) -> int:
        if len(self._sets) > self.limit:
            states = self._sets[row]
            self._reset()
            row = self._closed(states)
        target = self._closed([t for s in self._sets[row] for w, t in self.edges[s]
                               if w is None or w == word])
        self._rows[row][word] = target
        return target

    def search(self, found: list[bytes]) -> list[tuple[int, int]]:
        """(template, position of the last word) of every acceptance, in text order."""
        known = self._alphabet()
        hits, row = [], 0
        rows, ends = self._rows, self._hits
        for at, word in enumerate(found):
            if word not in known:
                word = b""
            target = rows[row].get(word)
            if target is None:
                target = self._step(row, word)
                rows, ends = self._rows, self._hits
            row = target
            if ends[row]:
                hits += [(number, at) for number in ends[row]]
        return hits

    def _alphabet(self) -> set[bytes]:
        if not hasattr(self, "_known"):
            self._known = {w for row in self.edges for w, _ in row if w is not None}
        return self._known


# Base phrases and their labels.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]


def optional(wording: str) -> str:
    return f"<<beginOptional>>{wording}<<endOptional>>"


def replaceable(name: str, match: str) -> str:
    return f'<<var;name="{name}";match="{match}">>'


# Names of holders and works: so many words, and no more, may stand in their places.
_HOLDER, _WORK = replaceable("holder", ".{1,16}"), replaceable("work", ".{1,8}")

# Wording of licenses and notices in wide use.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute "
    "sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so")
_MIT_CONDITION = (
    "subject to the following conditions the above copyright notice and this permission notice "
    + optional("including the next paragraph") +
    " shall be included in all copies or substantial portions of the software")
_MIT_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but "
    "not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall the " + replaceable("authors", "authors or copyright holders"
    "|authors|copyright holders|copyright holders or authors") + " be liable for any claim damages "
    "or other liability whether in an action of contract tort or otherwise arising from out of or "
    "in connection with the software or the use or other dealings in the software")

_BSD_OPENING = ("redistribution and use in source and binary forms with or without modification "
                "are permitted provided that the following conditions are met")
_BSD_SOURCE = (optional(replaceable("bullet", "1|a|i")) + " redistributions of source code must "
               "retain the above copyright notice this list of conditions and the following "
               "disclaimer" + optional("and"))
_BSD_BINARY = (optional(replaceable("bullet", "2|b|ii")) + " redistributions in binary form must "
               "reproduce the above copyright notice this list of conditions and the following "
               "disclaimer in the documentation and or other materials provided with the "
               "distribution" + optional("and"))
_BSD_ADVERTS = (optional(replaceable("bullet", "3|c|iii")) + " all advertising materials "
                "mentioning features or use of this software must display the following "
                "acknowledgement this product includes software developed by " + _HOLDER)
_BSD_NAMES = (optional(replaceable("bullet", "3|4|c|d|iii|iv")) + " neither the name of " + _HOLDER
              + " nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission")
_BSD_WARRANTY = (
    "this software is provided by " + _HOLDER + " as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a "
    "particular purpose are disclaimed in no event shall " + _HOLDER + " be liable for any direct "
    "indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business "
    "interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of "
    "this software even if advised of the possibility of such damage")

_APACHE_HEADER = (
    "licensed under the apache license version 2 0 the license you may not use "
    + replaceable("files", "this file|these files|this work|this software") +
    " except in compliance with the license you may obtain a copy of the license at "
    + optional(replaceable("scheme", "http|https") + " www apache org licenses license 2 0") +
    " unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either "
    "express or implied see the license for the specific language governing permissions and "
    "limitations under the license")

_GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license",
        "agpl": "gnu affero general public license"}
_GNU_VERSIONS = {"gpl": ["2", "3"], "lgpl": ["2 1", "3"], "agpl": ["3"]}

_ISC = (
    "permission to use copy modify " + replaceable("and", "and|and or") + " distribute this "
    "software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies the software is provided as "
    "is and " + _HOLDER + " disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness in no event shall " + _HOLDER + " be liable "
    "for any special direct indirect or consequential damages or any damages whatsoever resulting "
    "from loss of use data or profits whether in an action of contract negligence or other "
    "tortious action arising out of or in connection with the use or performance of this software")
_MPL_HEADER = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy "
    "of the mpl was not distributed with this file you can obtain one at "
    + replaceable("scheme", "http|https") + optional("www") + " mozilla org mpl 2 0")
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy "
    "modify publish use compile sell or distribute this software either in source code form or as "
    "a compiled binary for any purpose commercial or non commercial and by any means")

# Creative Commons: code and full name; words of a name may be written apart.
_CC = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives",
       "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike",
       "by nc nd": "attribution noncommercial noderivatives"}
_APART = {"noncommercial": "non commercial", "noderivatives": "no derivatives",
          "sharealike": "share alike"}


def _gnu_templates() -> list[Template]:
    """Short notices such as gpl-3.0, whole headers such as gpl-3.0-or-later-header."""
    found = []
    grant = "you can redistribute it and or modify it under the terms of "
    for code, name in _GNU.items():
        for version in _GNU_VERSIONS[code]:
            label = f"{code}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            number = replaceable("number", f"version {version}|v{version}|v {version}")
            verb = replaceable("verb", "licensed under|released under|distributed under"
                               "|available under|modify it under")
            found += [
                Template(label, f"{verb} {optional('the terms of')} the {name} {optional('as published '
                         'by the free software foundation')} {optional('either')} {number}"),
                Template(label, f"{verb} {optional('the terms of')} {number} of the {name}"),
                Template(f"{label}-or-later-header", f"{_WORK} is free software {grant} the {name} as "
                         "published by the free software foundation either version "
                         f"{version} of the license or at your option any later version"),
                Template(f"{label}-only-header", f"{_WORK} is free software {grant} the {name} version "
                         f"{version} {optional('only')} as published by the free software foundation"),
            ]
    return found


def _cc_templates() -> list[Template]:
    """cc-by-4.0 and its kin, by code, by name and by address."""
    found = []
    for code, name in _CC.items():
        spelled = " ".join(replaceable("word", f"{w}|{_APART[w]}") if w in _APART else w
                           for w in name.split())
        noise = optional(replaceable("kind", "license|licence|international|international license"
                                     "|international licence"))
        for version in ("2 0", "3 0", "4 0"):
            label = f"cc-{code.replace(' ', '-')}-{version.replace(' ', '.')}"
            found += [
                Template(label, f"cc {code} {noise} {optional('version')} {version}"),
                Template(label, f"creative commons {spelled} {optional('cc ' + code)} {noise} "
                         f"{optional('version')} {version}"),
                Template(label, f"creativecommons org licenses {code} {version}"),
            ]
    return found


# Whole licenses (-text), whole notices for the head of a file (-header), and short notices.
NOTICES = [
    Template("apache-2.0", f"licensed under the apache license {optional('version')} 2 0"),
    Template("apache-2.0-header", _APACHE_HEADER),
    Template("mit-notice", f"{replaceable('verb', 'released|licensed|distributed')} under the "
             f"{optional('terms of the')} mit license"),
    Template("mit-text", f"{_MIT_GRANT} {_MIT_CONDITION} {_MIT_WARRANTY}"),
    Template("mit-0-text", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    Template("json-text", f"{_MIT_GRANT} {_MIT_CONDITION} the software shall be used for good not "
             f"evil {_MIT_WARRANTY}"),
    Template("isc-text", _ISC),
    Template("bsd-2-clause-text", f"{_BSD_OPENING} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    Template("bsd-3-clause-text", f"{_BSD_OPENING} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} "
             f"{_BSD_WARRANTY}"),
    Template("bsd-4-clause-text", f"{_BSD_OPENING} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_ADVERTS} "
             f"{_BSD_NAMES} {_BSD_WARRANTY}"),
    Template("mpl-2.0-header", _MPL_HEADER),
    Template("unlicense-opening", _UNLICENSE),
    *_gnu_templates(),
    *_cc_templates(),
    Template("all-rights-reserved", "all rights reserved"),
    Template("copyright-notice", f"copyright {_HOLDER} all rights reserved"),
]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: list[Template] | None = None) -> DataFrame:
    """One row per input row: id, n_words, hits, phrases, labels, score.

    `hits` lists every accepted place of a notice as (label, last_word), `phrases` every
    place of a base phrase as (label, first_word). `labels` are all labels, distinct and
    sorted. `score` is 1 - 2**-m, m the number of mandatory words of the longest accepted
    template or phrase, 0 without one: more wording that has to agree is stronger evidence.
    Several templates may share a label. A `-text` label stands for the whole license: words added
    to, taken from or changed in its mandatory wording leave it without the label.

    Texts are read whole, in one pass of a table-driven automaton that follows all
    templates from all places at once, so time is linear in the text whatever repeats. No
    shuffle. Null and empty texts have no words. Ids may repeat or be null; rows are
    answered one by one. Other columns are ignored, whatever their names.
    """
    templates = [*PHRASES, *(NOTICES if templates is None else templates)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automaton = Automaton(templates)
        label = [t.label for t in templates]
        phrase = [t.phrase for t in templates]
        for batch in batches:
            out = {"id": batch["id"], "n_words": [], "hits": [], "phrases": [], "labels": [],
                   "score": []}
            for text in batch["text"]:
                found = words(text)
                hits = automaton.search(found)
                longest = max((automaton.mandatory[n] for n, _ in hits), default=0)
                out["n_words"].append(len(found))
                out["hits"].append([{"label": label[n], "last_word": at}
                                    for n, at in hits if not phrase[n]])
                out["phrases"].append([{"label": label[n],
                                        "first_word": at + 1 - automaton.mandatory[n]}
                                       for n, at in hits if phrase[n]])
                out["labels"].append(sorted({label[n] for n, _ in hits}))
                out["score"].append(1.0 - 0.5 ** longest if longest else 0.0)
            yield out

    return arrow_map(
        docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")), run,
        f"id {kind}, n_words bigint, hits array<struct<label:string,last_word:bigint>>, "
        "phrases array<struct<label:string,first_word:bigint>>, labels array<string>, score double")
