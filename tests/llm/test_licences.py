import random

import pytest

from playframe.llm import licences

from .test_text_operators import slow_dice


def found(text, templates=licences.TEMPLATES):
    return licences.Scanner(templates, licences.THRESHOLD).matches(text)


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'


@pytest.mark.parametrize(
    ("before", "notice", "after", "licence"),
    [
        ("Copyright 2020 Jane Doe. ", "Released under the MIT License", ".", "MIT"),
        ("The İstanbul parser ", "is released under the MIT License", " by its authors and can be used by all of them.", "MIT"),
        ("See the file that comes with it: ", "Licensed under the Apache License, Version 2.0", ' (the "License"); you may not use this work here at all', "Apache-2.0"),
        ("Much prose\nstands before ", "released under\nthe MIT\n\nLicense", "\nand behind it", "MIT"),
    ],
)
def test_notices_among_other_words(before, notice, after, licence):
    start, end = len(before), len(before + notice)
    hits = [m for m in found(before + notice + after) if m[0] == licence]
    assert [m[1] for m in hits] == ["window"]
    assert start <= hits[0][2] <= start + 3 and hits[0][3] == end


def test_licence_over_paragraphs_inside_prose():
    bsd = next(t for n, t in licences.TEMPLATES if n == "BSD-2-Clause")
    head, one, two = bsd.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").split("\n\n")
    prose = " ".join(f"word{i}" for i in range(400))
    text = f"{prose}\n\n{head}\n\n{one}\n\n{two}\n\n{prose}"
    (hit,) = [m for m in found(text) if m[0] == "BSD-2-Clause" and m[1] == "window"]
    assert text[hit[2] : hit[3]] == f"{head}\n\n{one}\n\n{two}"[:-1] and hit[4] == 1.0


def test_windows_equal_brute_force():
    templates = (("A", "a b c d e"), ("B", "b c b c d d a"), ("C", "e d c b a a b e c"), ("D", "a b"))
    rng = random.Random(3)
    n = 0
    for _ in range(150):
        words = [rng.choice("abcdexy") for _ in range(rng.randint(0, 26))]
        scanner = licences.Scanner(templates, 0.8)
        ids = licences.np.array([scanner.numbers.get(b, 0) for b in zip(words, words[1:])], int)
        got = [(scanner.templates[k][2], a, z, d) for k, a, z, d in scanner.windows(ids, scanner._likely(ids))] if ids.any() else []
        free, want = [(0, len(words) - 1)], []
        while free:
            lo, hi = free.pop()
            best = None
            for k, (size, _, name) in enumerate(scanner.templates):
                text = dict((n, t) for n, t in templates)[name]
                for a in range(lo, hi):
                    for z in range(a + 1, hi + 1):
                        dice = slow_dice(" ".join(words[a : z + 1]), text)
                        if dice >= 0.8:
                            key = (-round((dice - 0.8) * (z - a + size), 6), k, a, z, dice, name)
                            best = min(best, key) if best else key
            if best:
                _, _, a, z, dice, name = best
                want.append((name, a, z, dice))
                free += [(lo, a - 1), (z + 1, hi)]
        assert got == sorted(want, key=lambda x: x[1])
        n += len(got)
    assert n > 30


DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

"""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.

"""
WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
FSF = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
PUBLISHED = [
    ("BSD-2-Clause", BSD + DISCLAIMER),
    ("BSD-3-Clause", BSD + THIRD + DISCLAIMER),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + FSF.format(2) + WARRANTY),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + FSF.format(2.1)),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + FSF.format(3)),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + FSF.format(3)),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0"),
]


@pytest.mark.parametrize(("licence", "wording"), PUBLISHED)
def test_published_wording(licence, wording):
    prose = " ".join(f"word{i}" for i in range(300))
    assert {m[0] for m in found(wording)} == {licence}
    assert {m[0] for m in found(f"{prose} {wording} {prose}")} == {licence}


#: What the published text says at its beginning or end; and the licence's own notices, which texts of the GNU and some other licences quote.
BODIES = {
    "0BSD": "fee is hereby granted. THE SOFTWARE", "AGPL-3.0": "13. Remote Network Interaction", "Apache-2.0": "APPENDIX: How to apply the Apache License", "Artistic-1.0-Perl": "Artistic License",
    "BSD-2-Clause": "EVEN IF ADVISED", "BSD-3-Clause": "3. Neither the name", "BSL-1.0": "machine-executable object code", "CC-BY-SA-4.0": "Section 3 -- License Conditions", "CC0-1.0": "Affirmer",
    "EPL-1.0": "COMMERCIAL DISTRIBUTION", "GFDL-1.2": "Version 1.2, November 2002", "GFDL-1.3": "11. RELICENSING", "GPL-1.0": "Version 1, February 1989", "GPL-2.0": "Version 2, June 1991", "GPL-3.0": "11. Patents.",
    "ISC": "TORTIOUS ACTION", "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE", "LGPL-2.1": "Version 2.1, February 1999", "LGPL-3.0": "Combined Works", "MIT": "OR OTHER DEALINGS IN THE SOFTWARE", "MPL-1.1": "MULTIPLE-LICENSED CODE",
    "MPL-2.0": "Incompatible With Secondary Licenses", "Unlicense": "In jurisdictions that recognize copyright laws", "Zlib": "altered source versions",
}


@pytest.mark.parametrize("licence", sorted(BODIES))
def test_whole_text_in_prose_with_changed_words(licence):
    words = dict(licences.TEXTS)[licence].split()
    assert BODIES[licence].lower() in " ".join(words).lower()
    for i in range(20, len(words), 40):
        words[i] = "changed"
    lines = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11)).split("\n")
    prose = " ".join(f"word{i}" for i in range(3 * len(words)))
    text = f"{prose}\n\n" + "\n\n".join("\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)) + f"\n\n{prose}"
    windows = [m for m in found(text) if m[3] - m[2] > 0.9 * len(" ".join(words))]
    assert [m[:2] for m in windows] == [(licence, "window")]


def test_every_text_has_a_test():
    assert {n for n, _ in licences.TEXTS} == set(BODIES)
