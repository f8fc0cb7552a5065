"""Licence notices as they occur: wrapped, with words between, several on a line."""

from framewise.llm import licenses


def confirmed(text):
    scanner = licenses.scanner(tuple(licenses.TEMPLATES.items()), licenses.DIFFER)
    return [(line, n, name) for line, n, name, *_, ok, _ in scanner.scan(text) if ok]


def test_a_notice_may_start_before_the_line_of_its_stem():
    text = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */\nint x;"
    assert confirmed(text) == [(0, 2, "MPL-2.0")]


def test_every_notice_of_a_line_is_found():
    text = "Code: Released under the MIT License. Text: Licensed under CC BY 4.0. Licensed under the Apache License, Version 2.0. End"
    assert confirmed(text) == [(0, 1, "MIT"), (0, 1, "CC-BY-4.0"), (0, 1, "Apache-2.0")]
    wrapped = "Released under\nthe MIT License. Licensed under\nCC BY 4.0."
    assert confirmed(wrapped) == [(0, 2, "MIT"), (1, 2, "CC-BY-4.0")]
    assert confirmed(" ".join(["Released under the MIT License."] * 7)) == [(0, 1, "MIT")] * 7


def test_added_words_push_no_template_word_out():
    text = licenses.TEMPLATES["MIT-text"].replace("free of charge", "free of any charge").replace("conditions:", "conditions of use:")
    assert confirmed("Copyright someone\n" + text + " More text.") == [(1, 1, "MIT-text")]
    cut = licenses.TEMPLATES["GPL-3.0"].replace("work", "whole work")
    assert confirmed(cut) == [(0, 1, "GPL-3.0")]


def test_names_and_numbers_must_be_the_same():
    text = licenses.TEMPLATES["GPL-3.0"]
    assert confirmed(text.replace("3", "4")) == []
    assert confirmed(text.replace("General", "Lesser General")) == [(0, 1, "LGPL-3.0")]
    later = "This work is licensed under the GNU General Public License, version 3 or later."
    assert confirmed(later) == [(0, 1, "GPL-3.0")]


MIT = """Copyright (c) 2021 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """# {what} is free software; you can redistribute it and/or modify
# it under the terms of the GNU {name}General Public License as published by
# the Free Software Foundation; either version {version} of the License, or
# (at your option) any later version.
"""
REST = """#
# {what} is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU {name}General Public License for more details.
#
# You should have received a copy of the GNU {name}General Public License
# along with {what}.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_canonical_texts_and_headers():
    assert confirmed(MIT) == [(2, 17, "MIT-full")]
    assert confirmed(" ".join(MIT.split())) == [(0, 1, "MIT-full")]
    assert [x[2] for x in confirmed(MIT.replace("persons to whom", "all persons to whom") + "\n" + MIT)] == ["MIT-full"] * 2
    kinds = [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]
    for short, name, version in kinds:
        for what in ("This program", "This library", "Foo"):
            given = {"what": what, "name": name, "version": version}
            assert [x[2] for x in confirmed(GPL.format(**given))] == [f"{short}-or-later"]
            assert [x[2] for x in confirmed((GPL + REST).format(**given))] == [f"{short}-or-later-header"]
    assert confirmed(GPL.format(what="Foo", name="", version="4")) == []
    only = "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
    assert [x[2] for x in confirmed("This program is free software; " + only)] == ["GPL-2.0-only-after"]
    apache = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.'
    assert [x[2] for x in confirmed(apache)] == ["Apache-2.0"]
    assert [x[2] for x in confirmed(licenses.TEMPLATES["Apache-2.0-header"].replace("http:", "https:"))] == ["Apache-2.0-header"]
    holder = licenses.TEMPLATES["BSD-3-Clause-bullets"].replace("the copyright holder nor", "Example Inc. nor").replace("HOLDER OR", "OWNER OR")
    assert [x[2] for x in confirmed("Copyright 2001\n" + holder)] == ["BSD-3-Clause-bullets"]
