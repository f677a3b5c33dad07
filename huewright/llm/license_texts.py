"""Passages of public licences and licence notices, each with its mandatory key phrase."""

# Passages as published. In a key phrase, words with | between them are alternatives, and one with ? behind it may be missing.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions"""
BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"""
BSD_CODE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
ZLIB_ORIGIN = """The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the
License, or (at your option) any later version."""
LESSER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1
of the License, or (at your option) any later version."""
AFFERO = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC
LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"""
CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"""

_MIT_KEY = "granted free of charge|charges to any person obtaining a copy of this software and? associated documentation files"
_GPL_KEY = "gnu general public license|licence as published by the free software foundation either version {n}"
#: Name of each licence, with its passages and their key phrases.
PASSAGES: dict[str, tuple[tuple[str, str], ...]] = {
    "mit": ((MIT[: MIT.index(", including")], _MIT_KEY), (MIT, _MIT_KEY)),
    "mit-notice": (("Released under the MIT License", "mit license|licence"),),
    "bsl-1.0": ((BSL, "person or organization|organisation obtaining a copy of the software and? accompanying documentation"),),
    "bsd": ((BSD, "redistribution and? use in source and? binary forms|form"), (BSD_CODE, "redistributions of source code must retain the above copyright notice|notices"), (BSD_BINARY, "redistributions in binary form|forms must reproduce the above copyright notice|notices")),
    "bsd-3-clause": ((BSD_NAMES, "names of its contributors may be? used to endorse or? promote products derived"),),
    "isc": ((ISC[: ISC.index(", provided")], "permission to use copy modify and? or? distribute this software"), (ISC, "permission to use copy modify and? or? distribute this software")),
    "zlib": ((ZLIB, "alter it and? redistribute it freely subject to the following restrictions|conditions"), (ZLIB_ORIGIN, "origin of this software must not be misrepresented|misstated")),
    "apache-2.0": (("Licensed under the Apache License, Version 2.0", "apache license|licence version|v 2 0?"), (APACHE, "apache license|licence version|v 2 0?")),
    "gpl-3.0": (("This work is licensed under the GNU General Public License, version 3", "gnu general public license|licence version|v 3"), (GPL.format(n=3), _GPL_KEY.format(n=3))),
    "gpl-2.0": (
        ("it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2", _GPL_KEY.format(n=2)),
        ("This work is licensed under the GNU General Public License, version 2", "gnu general public license|licence version|v 2"),
        (GPL.format(n=2), _GPL_KEY.format(n=2)),
    ),
    "lgpl": (("This library is licensed under the GNU Lesser General Public License", "lesser general public license|licence"), (LESSER, "lesser general public license|licence")),
    "agpl": (("This work is licensed under the GNU Affero General Public License", "affero general public license|licence"), (AFFERO, "affero general public license|licence")),
    "mpl-2.0": ((MPL[: MPL.index(". If")], "mozilla public license|licence v|version 2 0?"), (MPL, "mozilla public license|licence v|version 2 0?")),
    "epl-2.0": ((EPL, "eclipse public license|licence v? 2 0?"),),
    "cc-by-nc-4.0": (("Licensed under CC BY-NC 4.0", "cc by nc 4 0?"),),
    "cc-by-sa-4.0": (("Licensed under CC BY-SA 4.0", "cc by sa 4 0?"),),
    "cc-by-4.0": (("Licensed under CC BY 4.0", "cc by 4 0?"),),
    "cc0": (("released under CC0 1.0 Universal", "cc0 1 0? universal"), (CC0, "author|person has waived all copyright and? related or? neighboring|neighbouring rights")),
    "unlicense": ((UNLICENSE[: UNLICENSE.index(". Anyone")], "free and? unencumbered software released into the public domain"), (UNLICENSE, "free and? unencumbered software released into the public domain")),
    "wtfpl": ((WTFPL, "you want to public license|licence"),),
}
