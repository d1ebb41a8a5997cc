"""Texts, headers and short notices of public licenses, by SPDX-like name.

``-text`` is the whole license as in ``license_texts``; ``-header`` the first
paragraph of what stands in source files, ``-header-whole`` all of it; ``-grant`` the
permission alone, for texts that break off before the warranty.
"""

from __future__ import annotations

from importlib.resources import files


def _texts() -> dict[str, str]:
    folder = files("tastemap.llm") / "license_texts"
    return {f"{f.name[:-4]}-text": f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


def _gnu() -> dict[str, str]:
    """Notices of the GNU licenses, of one version and of any later one."""
    out = {}
    for short, name, what, versions in (
        ("GPL", "General Public License", "program", ("1", "2", "3")),
        ("LGPL", "Library General Public License", "library", ("2",)),
        ("LGPL", "Lesser General Public License", "library", ("2.1", "3")),
        ("AGPL", "Affero General Public License", "program", ("3",)),
    ):
        for v in versions:
            key = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            out[key] = f"This work is licensed under the GNU {name}, version {v}."
            start = (
                f"This {what} is free software: you can redistribute it and/or modify it under the terms of "
                f"the GNU {name}"
            )
            later = (
                f"{start} as published by the Free Software Foundation, either version {v} of the License, "
                "or (at your option) any later version."
            )
            only = f"{start} version {v} as published by the Free Software Foundation."
            warranty = (
                f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
                "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
                f"See the GNU {name} for more details. You should have received a copy of the GNU {name} "
                f"along with this {what}. If not, see <https://www.gnu.org/licenses/>."
            )
            out[f"{key}-header"], out[f"{key}-header-whole"] = later, later + warranty
            out[f"{key}-only-header"], out[f"{key}-only-header-whole"] = only, only + warranty
    return out


def _creative_commons() -> dict[str, str]:
    out = {}
    for short, name in (
        ("BY", "Attribution"),
        ("BY-SA", "Attribution-ShareAlike"),
        ("BY-NC", "Attribution-NonCommercial"),
        ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ):
        for v, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic")):
            if v != "4.0":
                name = name.replace("NoDerivatives", "NoDerivs")
            out[f"CC-{short}-{v}-short"] = f"Licensed under CC {short} {v}."
            out[f"CC-{short}-{v}-notice"] = f"This work is licensed under a Creative Commons {name} {v} {port} License."
    # The names that these two have had from the start.
    out["CC-BY-NC-4.0"] = out.pop("CC-BY-NC-4.0-short")
    out["CC-BY-4.0"] = out.pop("CC-BY-4.0-notice")
    return out


TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-1.1": "Licensed under the Apache Software License, Version 1.1.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "MPL-1.1-header": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the "
        '"License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.mozilla.org/MPL/"
    ),
    **_gnu(),
    **_creative_commons(),
    **_texts(),
}
