"""Further notices and openings of public licenses, by version and family.

A whole license text is known by its title, date or opening words, and the short ones (BSD) by all
of theirs: sister licenses share most of a long body, which so would name several of them.
"""

from __future__ import annotations

_GNU = [
    ("GPL", "GNU General Public License", ("1", "2", "3")),
    ("LGPL", "GNU Library General Public License", ("2",)),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
    ("AGPL", "GNU Affero General Public License", ("3",)),
]
_GRANT = "This {} is free software: you can redistribute it and/or modify it under the terms of the {}"
_BY = "as published by the Free Software Foundation"


def _gnu() -> list[tuple[str, str]]:
    out = []
    for short, long, versions in _GNU:
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            out.append((name, f"This work is licensed under the {long}, version {v}."))
            for grant in (_GRANT.format("program", long), _GRANT.format("library", long)):
                out += [
                    (name, f"{grant} {_BY}, either version {v} of the License, or (at your option) any later version."),
                    (name, f"{grant} {_BY}, version {v} of the License."),
                    (name, f"{grant} version {v} {_BY}."),
                ]
    return out


_CC = [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]


def _cc() -> list[tuple[str, str]]:
    out = []
    for short, long in _CC:
        for v, kind in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            full = long if v == "4.0" else long.replace("NoDerivatives", "NoDerivs")
            out += [(f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {full} {v} {kind} License."), (f"CC-{short}-{v}", f"Licensed under CC {short} {v}.")]
        own = f"Creative Commons {long} 4.0 International Public License"
        out.append((
            f"CC-{short}-4.0",
            f"{own} By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this {own} (\"Public License\").",
        ))
    return out


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_CREDIT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by "
_NAMES = (
    "{}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_ECLIPSE = (
    "Eclipse Public License - v {} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). "
    "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."
)
_MADE = "This program and the accompanying materials are made available under the terms of the Eclipse Public License "

MORE: list[tuple[str, str]] = [
    *_gnu(),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    *_cc(),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + _NAMES.format(3) + _AS_IS),
    ("BSD-4-Clause", _BSD + _CREDIT + _NAMES.format(4) + _AS_IS),
    ("EPL-1.0", _ECLIPSE.format("1.0")),
    ("EPL-2.0", _ECLIPSE.format("2.0")),
    ("EPL-1.0", _MADE + "v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", _MADE + "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", _MADE + "v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. \"Commercial Use\" means distribution or otherwise making the Covered Code available to a third party."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Artistic-1.0", "The \"Artistic License\" Preamble The intent of this document is to state the conditions under which a Package may be copied"),
    ("OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"),
    (
        "Zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
]
