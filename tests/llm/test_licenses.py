"""Wordings of license notices as they stand in files, and texts that only look like notices."""

import pytest
from pyspark.sql import functions as F

from kpiloom.llm import licenses

NOTICES = {
    "mit": """Licensed under the MIT license.|Released under MIT|MIT licence|MIT License|This project is MIT licensed.|License: MIT|license = "MIT"
"license": "MIT"|Distributed under the terms of the MIT license|SPDX-License-Identifier: MIT|https://opensource.org/licenses/MIT|http://opensource.org/licenses/mit-license
Available under the MIT License (see LICENSE).|Permission is hereby granted, free of charge, to any person obtaining a copy of this software|Expat license
[MIT](https://choosealicense.com/licenses/mit/)|covered by the MIT license|License :: OSI Approved :: MIT License|licensed under an MIT-style license: MIT license
The above copyright notice and this permission notice shall be included in all copies or substantial portions|used under the terms of the MIT license""",
    "mit-0": "MIT-0|MIT No Attribution|SPDX-License-Identifier: MIT-0",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License");|Apache License 2.0|Apache 2.0 license|Licensed under Apache 2.0|License: Apache-2.0
SPDX-License-Identifier: Apache-2.0|http://www.apache.org/licenses/LICENSE-2.0|https://www.apache.org/licenses/LICENSE-2.0.txt|released under the Apache 2 license
The Apache Software License, Version 2.0|under the Apache License v2.0|License :: Apache License, Version 2.0|Apache License\n   Version 2.0, January 2004
distributed under the Apache License, Version 2|https://opensource.org/licenses/Apache-2.0|you may not use this file except in compliance with the License.|Apache v2 license""",
    "apache": "the Apache license|Licensed under the Apache License|Apache Software License",
    "gpl": """Licensed under the GPL|GPL license|released under the GNU GPL|GNU General Public License|http://www.gnu.org/licenses/gpl.html|distributed under the terms of the GPL
https://www.gnu.org/copyleft/gpl.html|License: GPL|under the GNU General Public Licence""",
    "gpl-2": """GPLv2|GPL-2.0|GPL v2|GNU GPL version 2|GNU General Public License, version 2|GNU General Public License v2.0|version 2 of the GNU General Public License
SPDX-License-Identifier: GPL-2.0|https://www.gnu.org/licenses/old-licenses/gpl-2.0.html|License: GPL 2|Licensed under the GPL 2.0 license""",
    "gpl-2-or-later": """GPL-2.0-or-later|GPLv2+|GPL 2.0+|SPDX-License-Identifier: GPL-2.0-or-later|SPDX-License-Identifier: GPL-2.0+|GPL version 2 or later|GPLv2 or any later version
GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.|version 2 of the GNU General Public License or any later version""",
    "gpl-2-only": "GPL-2.0-only|SPDX-License-Identifier: GPL-2.0-only|GPLv2 only",
    "gpl-3": """GPLv3|GPL-3.0|Released under the GNU GPL v3|GNU GPLv3|GNU General Public License v3.0|licensed under the GNU General Public License, version 3|https://www.gnu.org/licenses/gpl-3.0.en.html
SPDX-License-Identifier: GPL-3.0|GPL version 3|license: gpl-3.0|https://opensource.org/licenses/GPL-3.0|distributed under the GPL v3 license""",
    "gpl-3-or-later": """GPL-3.0-or-later|GPLv3+|GPL-3.0+|GPLv3 or later|GNU GPL version 3 or newer
it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.""",
    "lgpl": "Licensed under the LGPL|LGPL license|GNU Lesser General Public License|GNU Library General Public License|https://www.gnu.org/licenses/lgpl.html",
    "lgpl-2.1": """LGPL-2.1|LGPLv2.1|GNU Lesser General Public License version 2.1|LGPL v2.1|https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html|SPDX-License-Identifier: LGPL-2.1
released under the terms of the GNU Lesser General Public License, version 2.1""",
    "lgpl-2.1-or-later": """LGPL-2.1-or-later|LGPLv2.1+|SPDX-License-Identifier: LGPL-2.1-or-later
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version""",
    "lgpl-3": "LGPL-3.0|LGPLv3|GNU Lesser General Public License v3|GNU LGPL version 3|https://www.gnu.org/licenses/lgpl-3.0.html",
    "agpl": "Licensed under the AGPL|GNU Affero General Public License",
    "agpl-3": "AGPL-3.0|AGPLv3|GNU Affero General Public License v3.0|GNU AGPL version 3|https://www.gnu.org/licenses/agpl-3.0.html|SPDX-License-Identifier: AGPL-3.0|licensed under the AGPL v3",
    "agpl-3-or-later": "AGPL-3.0-or-later|AGPLv3+|GNU Affero General Public License version 3 or later",
    "gfdl": "GNU Free Documentation License|GFDL license|licensed under the GFDL|https://www.gnu.org/licenses/fdl.html",
    "bsd": "licensed under the BSD|BSD license|released under a BSD-style license|Redistribution and use in source and binary forms, with or without modification|License: BSD",
    "bsd-2": "BSD-2-Clause|2-clause BSD license|Simplified BSD License|FreeBSD license|SPDX-License-Identifier: BSD-2-Clause|https://opensource.org/licenses/BSD-2-Clause|BSD two-clause license",
    "bsd-3": """BSD-3-Clause|3-Clause BSD License|New BSD license|Modified BSD License|Revised BSD license|SPDX-License-Identifier: BSD-3-Clause|license = "BSD-3-Clause"
Neither the name of the University nor the names of its contributors may be used to endorse or promote products""",
    "bsd-4": "BSD-4-Clause|original BSD license|All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-0": "0BSD|Zero-Clause BSD|SPDX-License-Identifier: 0BSD",
    "mpl-2": """MPL-2.0|MPL 2.0|Mozilla Public License 2.0|Mozilla Public License, version 2.0|subject to the terms of the Mozilla Public License, v. 2.0|http://mozilla.org/MPL/2.0/|https://www.mozilla.org/en-US/MPL/2.0/
SPDX-License-Identifier: MPL-2.0|Licensed under the MPLv2""",
    "mpl-1": "Mozilla Public License Version 1.1|licensed under the MPL 1.1|http://www.mozilla.org/MPL/1.1/",
    "mpl": "licensed under the MPL|Mozilla Public License",
    "epl-2": "EPL-2.0|Eclipse Public License 2.0|Eclipse Public License v2.0|https://www.eclipse.org/legal/epl-2.0/|SPDX-License-Identifier: EPL-2.0|available under the terms of the Eclipse Public License v. 2.0",
    "epl-1": "Eclipse Public License v1.0|http://www.eclipse.org/legal/epl-v10.html|licensed under the EPL 1.0",
    "cddl-1": "licensed under the CDDL|Common Development and Distribution License|CDDL license",
    "eupl-1.2": "Licensed under the EUPL|European Union Public Licence|EUPL v1.2 licence|SPDX-License-Identifier: EUPL-1.2",
    "artistic-2": "Artistic License 2.0|licensed under the Artistic License 2.0|SPDX-License-Identifier: Artistic-2.0",
    "artistic": "under the Artistic License|Perl Artistic License",
    "isc": "ISC License|licensed under the ISC|License: ISC|SPDX-License-Identifier: ISC|Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee",
    "zlib": "zlib license|licensed under the zlib/libpng license|SPDX-License-Identifier: Zlib|https://opensource.org/licenses/Zlib",
    "boost-1": "Boost Software License|Distributed under the Boost Software License, Version 1.0.|http://www.boost.org/LICENSE_1_0.txt|SPDX-License-Identifier: BSL-1.0",
    "unlicense": "This is free and unencumbered software released into the public domain.|The Unlicense|https://unlicense.org/|SPDX-License-Identifier: Unlicense",
    "wtfpl": "WTFPL|licensed under the WTFPL|http://www.wtfpl.net/|Do What The Fuck You Want To Public License",
    "postgresql": "PostgreSQL License|released under the PostgreSQL Licence",
    "python-2": "Python Software Foundation License|PSF-2.0 license",
    "ofl-1.1": "SIL Open Font License, Version 1.1|licensed under the SIL Open Font License|https://scripts.sil.org/OFL|SPDX-License-Identifier: OFL-1.1",
    "ms-pl": "Microsoft Public License|MS-PL license",
    "cc0": "CC0 1.0|CC0|licensed under CC0|https://creativecommons.org/publicdomain/zero/1.0/|Creative Commons Zero license|SPDX-License-Identifier: CC0-1.0|To the extent possible under law, the author has waived all copyright",
    "cc-by": """CC BY 4.0|CC-BY-4.0|licensed under CC BY 4.0|licensed under a Creative Commons Attribution 4.0 International License|https://creativecommons.org/licenses/by/4.0/|Creative Commons Attribution license|CC BY 3.0 license
CC Attribution license|SPDX-License-Identifier: CC-BY-4.0""",
    "cc-by-sa": "CC BY-SA 4.0|CC BY-SA 4.0 license|CC-BY-SA|Creative Commons Attribution-ShareAlike 3.0 Unported License|http://creativecommons.org/licenses/by-sa/3.0/|licensed under CC-BY-SA|Creative Commons Attribution-Share Alike license",
    "cc-by-nc": "CC BY-NC 4.0|Creative Commons Attribution-NonCommercial 4.0 license|https://creativecommons.org/licenses/by-nc/4.0/|licensed under CC-BY-NC|Creative Commons Attribution-Non Commercial License",
    "cc-by-nd": "CC BY-ND 4.0|Creative Commons Attribution-NoDerivatives license|https://creativecommons.org/licenses/by-nd/2.0/|CC-BY-ND",
    "cc-by-nc-sa": "CC BY-NC-SA 4.0|CC-BY-NC-SA license|Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License|https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "cc-by-nc-nd": "CC BY-NC-ND 4.0|Creative Commons Attribution-NonCommercial-NoDerivs 3.0 license|https://creativecommons.org/licenses/by-nc-nd/4.0/",
    "odbl-1": "Open Database License|licensed under the ODbL|https://opendatacommons.org/licenses/odbl/1-0/",
    "public-domain": "dedicated to the public domain|This work is in the public domain.",
    "proprietary": "All rights reserved.|Proprietary and confidential|Unauthorized copying of this file, via any medium, is strictly prohibited",
}

# expressions: every license of them
EXPRESSIONS = {
    "SPDX-License-Identifier: MIT OR Apache-2.0": {"mit", "apache-2"},
    'license = "MIT OR Apache-2.0"': {"mit", "apache-2"},
    '"license": "(MIT AND BSD-3-Clause)"': {"mit", "bsd-3"},
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": {"gpl-2-only", "classpath-exception"},
    "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": {"apache-2", "llvm-exception"},
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": {"mit", "apache-2"},
    "Dual licensed under the MIT license or GPL-3.0-or-later": {"mit", "gpl-3-or-later"},
    "License: MIT/Apache-2.0": {"mit", "apache-2"},
    "SPDX-License-Identifier: (LGPL-2.1-or-later OR MPL-2.0)": {"lgpl-2.1-or-later", "mpl-2"},
}

NEAR = """Wir gehen mit dem Hund in den Park.|He studied at MIT before he joined the bank.|The Apache helicopter flew low over the river.|An Apache web server, version 2.4, runs here.
The BSD kernel was written at Berkeley.|Mozilla Firefox is a browser.|The Eclipse foundation met; an eclipse of the sun followed.|Please CC by mail everyone on the list.|cc: by tomorrow noon
A driving licence is needed.|Her fishing license expired last May.|The license plate was blue.|Licensed plumbers are listed below.|Under the sea we saw a boat.|The artistic director left.
Python is a snake.|He gave a boost to the software team.|Version 2 of the plan was approved.|Version 3.0 of the report is out.|The general public is invited.|A lesser man would have left.
Open the database and read the font table.|The zero clause of the contract.|Creative people and commons rooms.|Use of this software is easy.|The names of its members are secret.|The gnu is an antelope.
The public domain name server failed over.|The unlicensed taxi waited.|A software licensing fair|The poetic licence he took|A TV licence costs money.|the marriage license bureau|licensed premises
L'été était long et les jours clairs.|permission to speak, sir|Rights are reserved for members alone.|European unions of public servants|mpl and epl are three letters each: no|Boost your sales by 2 0 percent""".replace("\n", "|").split("|")


def found(text):
    return {d.label for d in licenses.settle(licenses.detections(text.lower().encode()))}


def wordings():
    return [(label, w) for label, text in NOTICES.items() for w in text.replace("\n#", "\0").replace("\n   ", "\1").replace("\n", "|").replace("\0", "\n#").replace("\1", "\n   ").split("|")]


def test_real_wordings_are_recognised():
    rows = wordings()
    assert len(rows) >= 200 and len({label for label, _ in rows}) >= 40
    missed = [(label, w, found(w)) for label, w in rows if label not in found(w)]
    assert len(missed) <= 0.05 * len(rows), missed


def test_families_do_not_drown_their_members():
    """A notice of one version is not told as the family too, nor as another version."""
    versions = {k for k in NOTICES if k[-1].isdigit() or k.endswith(("later", "only"))} - {"zlib"}
    extra = [(label, w, found(w)) for label, w in wordings() if label in versions and found(w) - {label, "proprietary"} & (versions | set(licenses.FAMILIES))]
    extra = [x for x in extra if (x[2] - {x[0]}) & (versions | set(licenses.FAMILIES))]
    assert len(extra) <= 0.05 * len(wordings()), extra


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions_give_every_license(text):
    assert EXPRESSIONS[text] <= found(text)


def test_near_misses_give_none():
    wrong = [(t, found(t)) for t in NEAR if found(t)]
    assert wrong == []


def test_the_gate_loses_nothing_in_spark(spark, odd_docs):
    rows = [(k, f"Some text before.\n{w}\nand after", label) for k, (label, w) in enumerate(wordings())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    for r in licenses.scan_documents(docs).collect():
        assert {d["label"] for d in r["found"]} == found(r["text"]), r["text"]
    wide = odd_docs.withColumn("_scan", F.lit("mine"))
    assert licenses.scan_documents(wide).where("_scan = 'mine'").count() == odd_docs.count()
    assert licenses.scan_documents(odd_docs.limit(0)).collect() == []
