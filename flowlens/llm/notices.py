"""Notices of licence families, from which the classifier learns and with which its finds are compared."""

#: Names and identifiers of the families.
NAMES = {
    "AGPL": ("AGPL-3.0", "GNU Affero General Public License"),
    "Apache-2.0": ("Apache-2.0", "Apache License, Version 2.0"),
    "BSD": ("BSD-3-Clause", "BSD License"),
    "CC-BY": ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC": ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA": ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0": ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    "EPL": ("EPL-2.0", "Eclipse Public License 2.0"),
    "GPL": ("GPL-3.0", "GNU General Public License"),
    "ISC": ("ISC", "ISC License"),
    "LGPL": ("LGPL-3.0", "GNU Lesser General Public License"),
    "MIT": ("MIT", "MIT License"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense", "Unlicense"),
    "Zlib": ("Zlib", "zlib License"),
}

#: The notices.
TEXTS = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty.",
        "You should have received a copy of the CC0 Public Domain Dedication along with this work.",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
}

#: Sentences of no licence, some of which speak of licences.
ORDINARY = (
    "The meeting was moved to the second week of the month because the hall is closed.",
    "She has read the general report and the public version of the work.",
    "You can use this source of heat in any weather under the following conditions.",
    "All rights reserved. No part of this book may be reproduced in any form without permission of the publisher.",
    "This licence is not a licence, and the driver had no license with them.",
    "The software is sold under a commercial license agreement; please contact us for the terms.",
    "They studied at MIT and work for the Apache county office, version 2.0 of which opened in May.",
    "The general public was free to use the library, and a copy of the notice was given to any person.",
    "The foundation published the terms of the program, without warranty of any kind.",
    "Permission to film was granted by the city, subject to the usual restrictions.",
    "This work is distributed to all members, and the source is released each year.",
)


#: Notices of more words are compared in parts of so many, which overlap by half.
PART = 32


def parts(text: str) -> list[str]:
    words = text.split()
    if len(words) <= PART + PART // 2:
        return [text]
    return [" ".join(words[at : at + PART]) for at in range(0, len(words) - PART // 2, PART // 2)]


def templates() -> dict[str, list[str]]:
    """The notices of each family, long ones in parts, with the short forms of its name."""
    out = {}
    for family, (identifier, name) in NAMES.items():
        the = "the " if name.startswith(("GNU", "Apache", "BSD", "Eclipse", "ISC", "MIT", "Mozilla", "Unlicense", "zlib", "CC0")) else "a "
        out[family] = [f"SPDX-License-Identifier: {identifier}", f"Licensed under {the}{name}.", f"Released under {the}{name}.", *(p for text in TEXTS[family] for p in parts(text))]
    return out
