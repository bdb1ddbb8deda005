"""Precision and recall of licence labels on public notices, sentences that name licences, and sentences that only look like them."""

from test_others import _scanned

GNU = "under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
FREE = "This {} is free software: you can redistribute it and/or modify it "
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
CDDL = "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."
EUPL = "Licensed under the EUPL, Version 1.2 or later. You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at: https://joinup.ec.europa.eu/software/page/eupl"
NOTICES = [
    (MIT, "mit"), ("# " + MIT.replace(" ", "\n# "), "mit"), ("Released under the MIT License.", "mit"), ("This project is licensed under the MIT license - see LICENSE", "mit"),
    ("distributed under the MIT license", "mit"), ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: MIT\n// Copyright 2020", "mit"),
    (APACHE, "apache"), ("Licensed under the Apache License, Version 2.0", "apache"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("released under the Apache License 2.0", "apache"),
    ("under the Apache License, Version 1.1", "apache"), (" * " + APACHE.replace(". ", ".\n * "), "apache"),
    (FREE.format("program") + GNU.format("", "3"), "gpl"), (FREE.format("library") + GNU.format("Lesser ", "2.1"), "gpl,lgpl"), (FREE.format("program") + GNU.format("Affero ", "3"), "agpl,gpl"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("SPDX-License-Identifier: AGPL-3.0-only", "agpl"),
    ("This work is licensed under the GNU General Public License version 3", "gpl"), ("Licensed under the GPL, version 2", "gpl"), ("distributed under the GNU GPL", "gpl"), ("Licensed under the LGPL", "lgpl"),
    ("The library is released under the GNU Lesser General Public License", "gpl,lgpl"), ("Distributed under the AGPL", "agpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl"), ("released under the Mozilla Public License", "mpl"),
    (CC.format(""), "cc-by"), (CC.format("-NonCommercial"), "cc-by-nc"), (CC.format("-ShareAlike"), "cc-by-sa"), ("Licensed under CC BY 4.0", "cc-by"), ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC-BY-NC 4.0.", "cc-by-nc"), ("SPDX-License-Identifier: CC-BY-4.0", "cc-by"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"),
    (BSD, "bsd"), ("Released under the BSD License", "bsd"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("licensed under the 3-clause BSD license", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("SPDX-License-Identifier: ISC", "isc"), ("licensed under the ISC license", "isc"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "boost"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    (EPL, "epl"), ("licensed under the Eclipse Public License", "epl"), (CDDL, "cddl"), (EUPL, "eupl"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "zlib"),
    ("Copyright 2021 X. All rights reserved.", "reserved"), ("ALL RIGHTS\nRESERVED", "reserved"),
    # what only looks like a notice
    ("This work is not released under the MIT License, whatever else is said", "mit-phrase"), ("It will never be released under the MIT terms", ""), ("released under the MIT Lincoln license", ""),
    ("The band released an album under the label", ""), ("Drivers are licensed under the law of the state", ""), ("You may not use this file except in compliance with the License.", ""),
    ("He obtained the rights to all of the reserved seats", ""), ("The mit in the machine was released under pressure", ""), ("Unlike ours, theirs is licensed under the GPL", ""),
    ("permission is granted to use the library in the evening", ""), ("identifier of the license plate: MIT 204", ""), ("Tasks are distributed under the supervisor's eyes", ""),
    ("software is sold as is, in source and binary forms", ""), ("the contents of this file are subject to change without notice", ""), ("Creative people licensed this work to the commons of a city", ""),
]


def test_precision_and_recall():
    rows = _scanned([text for text, _ in NOTICES])
    right = wrong = missed = 0
    for (text, labels), row in zip(NOTICES, rows, strict=True):
        got = {x for x in row["labels"].split(",") if x}
        if labels == "mit-phrase":  # the base phrase stays, whatever is said about it
            assert got == {"mit"} and row["score"] == 0.0
            continue
        expected = {x for x in labels.split(",") if x}
        right += len(got & expected)
        wrong += len(got - expected)
        missed += len(expected - got)
        if got != expected:
            print(f"{text[:70]!r}: {sorted(got)} for {sorted(expected)}")
    print(f"{len(NOTICES)} texts: precision {right / (right + wrong):.3f}, recall {right / (right + missed):.3f}")
    assert len(NOTICES) >= 60 and right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95
