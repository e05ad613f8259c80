import random
import re

import pytest

from caretlake.llm.licenses import NOTICES, PHRASES, Automaton, Template, scan_licenses, words
from caretlake.llm.queries_licenses import _pattern
from tests.llm.conftest import HARD


def places(markup, text):
    automaton = Automaton([Template("x", markup)])
    return [at for _, at in automaton.search(words(text.encode()))]


@pytest.mark.parametrize("markup, text, hits", [
    ("a b", "A, b! a c a b", [1, 5]),
    ("a <<beginOptional>>x<<endOptional>> b", "a b a x b a y b", [1, 4]),
    ("a <<beginOptional>>x <<beginOptional>>y<<endOptional>> z<<endOptional>> b",
     "a x z b a x y z b a y b", [3, 8]),
    ('a <<var;name="n";original="o";match=".+">> b', "a b", []),
    ('a <<var;name="n";original="o";match=".+">> b', "a q r b", [3]),
    ('a <<var;name="n";match=".*">> b', "a b", [1]),
    ('a <<var;name="n";match="one two|three">> b', "a one two b a three b a one b", [3, 6]),
    ("a a b", "a a a b", [3]),
    ('a <<var;name="n";match=".{1,2}">> b', "a b", []),
    ('a <<var;name="n";match=".{1,2}">> b', "a x b a x y b a x y z b", [2, 6]),
    ('a <<var;name="n";match=".{0,1}">> b', "a b a x b a x y b", [1, 4]),
])
def test_markup(markup, text, hits):
    assert places(markup, text) == hits


@pytest.mark.parametrize("markup", ["<<beginOptional>>a<<endOptional>>", "a <<endOptional>>",
                                    "a <<beginOptional>> b", 'a <<var;match=".{3,2}">>'])
def test_bad_markup(markup):
    with pytest.raises(ValueError):
        Automaton([Template("x", markup)])


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD3 = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_CONDITION = MIT[MIT.index(", subject to"):MIT.index("THE SOFTWARE IS")]
_THIRD = BSD3[BSD3.index("3. Neither"):BSD3.index("THIS SOFTWARE IS")]

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the
License."""

GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version."""


@pytest.mark.parametrize("text, labels", [
    (MIT, ["mit-text"]),
    (MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "the authors"), ["mit-text"]),
    (MIT.replace("permission notice shall", "permission notice (including the next paragraph) shall"),
     ["mit-text"]),
    # Altered, cut and extended wording.
    (MIT.replace("without\nrestriction,", "without restriction, except that it may not be used for evil,"),
     []),
    (MIT[:MIT.index("The above")], []),
    (MIT.replace("free of charge", "for a fee"), []),
    (MIT.replace(_CONDITION, ". "), ["mit-0-text"]),
    (MIT.replace("THE SOFTWARE IS", "The Software shall be used for Good, not Evil. THE SOFTWARE IS"),
     ["json-text"]),
    (BSD3, ["bsd-3-clause-text"]),
    (BSD3.replace(_THIRD, ""), ["bsd-2-clause-text"]),
    (BSD3.replace(_THIRD, "3. You pay us. "), []),
    (BSD3.replace("the copyright holder nor", "the University of Nowhere, Some Town, nor"),
     ["bsd-3-clause-text"]),
    (BSD3.replace("3. Neither", "3. All advertising materials mentioning features or use of this software "
                  "must display the following acknowledgement: This product includes software developed "
                  "by the Example Project. 4. Neither"), ["bsd-4-clause-text"]),
    (BSD3.replace("the copyright holder nor", "x " * 17 + "nor"), []),
    (APACHE, ["apache", "apache-2.0", "apache-2.0-header"]),
    (APACHE.replace("WITHOUT WARRANTIES", "with warranties"), ["apache", "apache-2.0"]),
    (GPL3, ["gpl", "gpl-3.0", "gpl-3.0-or-later-header"]),
    (GPL3.replace(", or (at your option) any later version", ""), ["gpl", "gpl-3.0"]),
    (GPL3.replace("General", "Lesser General"), ["lgpl-3.0", "lgpl-3.0-or-later-header"]),
    ("Released under version 2 of the GNU General Public License.", ["gpl", "gpl-2.0"]),
    ("Creative Commons Attribution 4.0 International", ["cc-by-4.0"]),
    ("Creative Commons Attribution-ShareAlike 3.0", ["cc-by-sa-3.0"]),
    ("Creative Commons Attribution Non-Commercial License 4.0", ["cc-by-nc-4.0"]),
    ("https://creativecommons.org/licenses/by-nc-nd/2.0/", ["cc-by-nc-nd-2.0"]),
    ("CC BY-NC 4.0", ["cc-by", "cc-by-nc-4.0"]),
    ("Copyright (c) 2020 Some Body. All rights reserved.", ["all-rights-reserved", "copyright-notice"]),
    ("all rights reserved", ["all-rights-reserved"]),
])
def test_wording(text, labels):
    automaton = Automaton([*PHRASES, *NOTICES])
    body = f"# Some words before.\n{text}\nAnd some behind."
    assert sorted({automaton.templates[n].label for n, _ in automaton.search(words(body.encode()))}) == labels


def test_templates_as_patterns():
    """The automaton against regular expressions, on words drawn from the templates themselves."""
    rng = random.Random(5)
    templates = [*PHRASES, *NOTICES]
    patterns = [re.compile(_pattern(t.markup)[1]) for t in templates]
    automaton = Automaton(templates)
    assert [_pattern(t.markup)[0] for t in templates] == automaton.mandatory
    plain = [re.sub(r"<<(begin|end)Optional>>", " ", re.sub(
        r'<<var[^<>]*match="([^"|]*)[^<>]*>>', lambda m: "some one" if m[1][0] == "." else m[1], t.markup))
        for t in templates]
    for _ in range(400):
        found = " ".join(rng.choices(plain, k=rng.randint(1, 3))).split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            found[rng.randrange(len(found))] = rng.choice(["other", "gnu", "software"])
        spaced = "".join(f" {w} " for w in found)
        want = {n for n, p in enumerate(patterns) if p.search(spaced)}
        assert {n for n, _ in automaton.search(words(spaced.encode()))} == want


def test_a_small_table_finds_the_same():
    text = words(b"cc by x mit license gnu gnu general public license apache license " * 50)
    assert Automaton(PHRASES, limit=2).search(text) == Automaton(PHRASES).search(text)


def test_hard_rows(hard):
    got = scan_licenses(hard).collect()
    assert len(got) == len(HARD)
    found = [r for r in got if r.hits or r.phrases]
    assert [(r.id, r.labels) for r in found] == [(10, ["apache", "apache-2.0"])]
    (row,) = found
    assert row.n_words == 8 and row.phrases[0].first_word == 3 and row.score == 1 - 0.5 ** 7
    blank = [r for r in got if r.id in (3, 4, 5, 6)]
    assert all(r.n_words == 0 and r.labels == [] and r.score == 0 for r in blank)
    assert {r.n_words for r in got if r.id == 7} == {30_000}


def test_empty_table(nothing):
    assert scan_licenses(nothing).count() == 0
