"""Signature rules for licences, written over words.

A rule is a regular expression over a text's words, lower case and one blank apart. ``<`` stands before its keyword: a
text is only looked at around the keywords it holds, and there only with the rules of that keyword. Rules stand in
order; of two that find the same words the one of higher priority counts, then the earlier one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Priorities and how sure a rule of that kind is.
HINT, NAME, VERSIONED, NOTICE = range(4)
SURE = (0.4, 0.7, 0.9, 1.0)
#: Words around a keyword that a rule may read.
RADIUS = 32


@dataclass(frozen=True)
class Rule:
    label: str
    body: str
    priority: int
    base: bool = False

    @property
    def keywords(self) -> list[str]:
        """What may stand after ``<``: a word, or words in ``(?:a|b)``."""
        after = self.body.split("<", 1)[1]
        group = re.match(r"\(\?:([^()]*)\)(?= |\(|$)", after)
        return group[1].split("|") if group else [re.match(r"[^ (?]+(?= |\(|$)", after)[0]]

    @property
    def pattern(self) -> str:
        return f"(?:^| )({self.body})(?: |$)"


LICENSE = "licen[cs]e"
UNDER = "(?:licen[cs]ed|released|available|distributed) under (?:the )?(?:terms of the )?"


def _version(version: str) -> str:
    """``3.0`` as words: 3, 3 0, v3, v 3 0, version 3."""
    major, minor = version.split(".")
    return f"(?:version |v ?)?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


def _creative_commons() -> list[Rule]:
    spelled = {"nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s(?: works)?"}
    rules = []
    for parts in ("", "sa", "nd", "nc", "nc sa", "nc nd"):
        short = f"by {parts}".strip()
        label = "cc-" + short.replace(" ", "-")
        words = " ".join(["attribution", *(spelled[p] for p in parts.split())])
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            digits = version.replace(".", " ")
            rules += [
                Rule(f"{label}-{version}", f"<creativecommons org licenses {short} {digits}", NOTICE),
                Rule(f"{label}-{version}", f"creative <commons {words} (?:version |v )?{digits}(?: international| unported| generic)?(?: public)?(?: {LICENSE})?", VERSIONED),
                Rule(f"{label}-{version}", f"<cc {short} {digits}(?: international| unported| generic)?", VERSIONED),
            ]
        rules.append(Rule(label, f"creative <commons {words}(?: {LICENSE})?", NAME))
        if parts:
            rules.append(Rule(label, f"<cc {short}", NAME))
    return rules + [
        Rule("cc0-1.0", "<creativecommons org publicdomain zero 1 0", NOTICE),
        Rule("cc0-1.0", "<cc0(?: 1 0)?(?: universal)?", VERSIONED),
        Rule("cc0-1.0", "creative <commons zero(?: 1 0)?", VERSIONED),
        Rule("cc-pdm-1.0", "<creativecommons org publicdomain mark 1 0", NOTICE),
        Rule("cc", f"creative <commons {LICENSE}", HINT),
    ]


def _gnu() -> list[Rule]:
    kinds = {
        "gpl": ("general", ("1.0", "2.0", "3.0")),
        "lgpl": ("(?:lesser|library) general", ("2.0", "2.1", "3.0")),
        "agpl": ("affero general", ("1.0", "3.0")),
    }
    later = "(?: of the license)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"
    rules = []
    for short, (name, versions) in kinds.items():
        for v in versions:
            ver = _version(v)
            glued = v.removesuffix(".0").replace(".", " ")
            rules += [
                Rule(f"{short}-{v}-or-later", f"{name} public license as published by the free software <foundation either {ver}{later}", NOTICE),
                Rule(f"{short}-{v}", f"{name} public license {ver} as published by the free software <foundation", NOTICE),
                Rule(f"{short}-{v}-or-later", f"{name} <public {LICENSE} {ver}{later}", VERSIONED),
                Rule(f"{short}-{v}", f"{name} <public {LICENSE} {ver}", VERSIONED),
                Rule(f"{short}-{v}-or-later", f"<{short} {ver} or (?:any )?later", VERSIONED),
                Rule(f"{short}-{v}-only", f"<{short} {ver} only", VERSIONED),
                Rule(f"{short}-{v}", f"<{short} {ver}", VERSIONED),
                Rule(f"{short}-{v}", f"<(?:{short}v{glued}|{short}{glued})" if " " not in glued else f"<{short}v{glued}", VERSIONED),
            ]
        if short != "gpl":
            rules.append(Rule(short, f"{name} <public {LICENSE}", NAME))
        rules.append(Rule(short, f"(?:gnu |under the |under )<{short}(?: {LICENSE})?", NAME))
    rules += [Rule(f"gfdl-{v}", f"free <documentation {LICENSE} {_version(v)}", VERSIONED) for v in ("1.1", "1.2", "1.3")]
    return rules + [Rule("gfdl", f"free <documentation {LICENSE}", NAME)]


def _versioned() -> list[Rule]:
    """Families that are told by a name and a number: (label, name, versions)."""
    families = (
        ("apache", f"<apache(?: software)? {LICENSE}", "1.0 1.1 2.0"),
        ("mpl", f"<mozilla public {LICENSE}", "1.0 1.1 2.0"),
        ("mpl", "<mpl", "1.0 1.1 2.0"),
        ("epl", f"<eclipse public {LICENSE}", "1.0 2.0"),
        ("epl", "<epl", "1.0 2.0"),
        ("eupl", f"european union <public {LICENSE}", "1.0 1.1 1.2"),
        ("eupl", "<eupl", "1.0 1.1 1.2"),
        ("cddl", f"common development and <distribution {LICENSE}", "1.0 1.1"),
        ("cddl", "<cddl", "1.0 1.1"),
        ("osl", f"open <software {LICENSE}", "1.0 1.1 2.0 2.1 3.0"),
        ("afl", f"<academic free {LICENSE}", "1.1 1.2 2.0 2.1 3.0"),
        ("artistic", f"<artistic {LICENSE}", "1.0 2.0"),
        ("cpl", f"common <public {LICENSE}", "1.0"),
        ("ipl", f"ibm <public {LICENSE}", "1.0"),
        ("bsl", f"boost <software {LICENSE}", "1.0"),
        ("busl", f"business <source {LICENSE}", "1.1"),
        ("sspl", f"server side <public {LICENSE}", "1.0"),
        ("elastic", f"<elastic {LICENSE}", "1.0 2.0"),
        ("ofl", f"(?:sil )?open <font {LICENSE}", "1.0 1.1"),
        ("odbl", f"open <database {LICENSE}", "1.0"),
        ("odc-by", f"open data <commons attribution {LICENSE}", "1.0"),
        ("psf", f"python <software foundation {LICENSE}", "2.0"),
        ("php", f"<php {LICENSE}", "3.0 3.01"),
        ("zpl", f"<zope public {LICENSE}", "1.1 2.0 2.1"),
        ("lppl", f"latex project <public {LICENSE}", "1.0 1.1 1.2 1.3"),
        ("cecill", "<cecill", "1.0 1.1 2.0 2.1"),
        ("qpl", f"q <public {LICENSE}", "1.0"),
        ("upl", "universal permissive <license", "1.0"),
        ("nasa", f"nasa open <source agreement", "1.3"),
    )
    rules = []
    for label, name, versions in families:
        rules += [Rule(f"{label}-{v}", f"{name} {_version(v)}", VERSIONED) for v in versions.split()]
        rules.append(Rule(label, name, NAME))
    for v in ("1.0", "1.1", "2.0"):
        digits = v.replace(".", " ")
        rules += [Rule(f"apache-{v}", f"<apache org licenses license {digits}", NOTICE), Rule(f"apache-{v}", f"<apache {digits}", VERSIONED)]
    return [*rules, Rule("apache-2.0", f"{UNDER}<apache {LICENSE} version 2 0(?: the license)?", NOTICE)]


def _bsd() -> list[Rule]:
    counts = {0: "zero|0", 1: "one|1", 2: "two|2|simplified|free", 3: "three|3|new|modified|revised", 4: "four|4|original|old"}
    rules = []
    for n, words in counts.items():
        rules += [Rule(f"bsd-{n}-clause", f"<bsd (?:{words})(?: clause)?(?: {LICENSE})?", VERSIONED), Rule(f"bsd-{n}-clause", f"(?:{words})(?: clause)? <bsd(?: {LICENSE})?", VERSIONED)]
    return rules + [
        Rule("bsd", f"<bsd(?: style)? {LICENSE}", NAME),
        Rule("bsd-2-clause", "<redistribution and use in source and binary forms with or without modification are permitted", NOTICE),
        Rule("bsd-3-clause", "may be used to <endorse or promote products derived from this software", NOTICE),
        Rule("bsd-4-clause", "all advertising materials <mentioning features or use of this software", NOTICE),
    ]


def _others() -> list[Rule]:
    return [
        Rule("mit", "<permission is hereby granted free of charge to any person obtaining a copy of this software", NOTICE),
        Rule("mit-0", "<mit no attribution", VERSIONED),
        Rule("mit", "opensource org licenses <mit", NOTICE),
        Rule("mit", f"<mit(?: style| expat)? {LICENSE}", VERSIONED),
        Rule("mit", f"{UNDER}<mit", VERSIONED),
        Rule("isc", "<permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", NOTICE),
        Rule("isc", f"<isc {LICENSE}", VERSIONED),
        Rule("zlib", f"<zlib(?: libpng)? {LICENSE}", VERSIONED),
        Rule("zlib", "this software is provided as is without any express or implied <warranty in no event will the authors be held liable", NOTICE),
        Rule("unlicense", "this is free and unencumbered software released into the public <domain", NOTICE),
        Rule("unlicense", "<(?:unlicense|unlicence)", NAME),
        Rule("wtfpl", "<wtfpl", VERSIONED),
        Rule("wtfpl", f"do what the f[a-z0-9]* you want to <public {LICENSE}", VERSIONED),
        Rule("ms-pl", f"<microsoft public {LICENSE}", VERSIONED),
        Rule("ms-rl", f"<microsoft reciprocal {LICENSE}", VERSIONED),
        Rule("openssl", f"<openssl {LICENSE}", VERSIONED),
        Rule("ncsa", f"<ncsa(?: open source)? {LICENSE}", VERSIONED),
        Rule("postgresql", f"<postgresql {LICENSE}", VERSIONED),
        Rule("vim", f"<vim {LICENSE}", VERSIONED),
        Rule("json", "the software shall be used for good not <evil", NOTICE),
        Rule("beerware", "the beer <ware license", VERSIONED),
        Rule("ruby", f"<ruby {LICENSE}", VERSIONED),
        Rule("curl", f"<curl {LICENSE}", VERSIONED),
        Rule("llama", "<llama (?:2 |3 |3 1 )?community license", VERSIONED),
        Rule("openrail", "<openrail", NAME),
        Rule("pddl", "public <domain dedication and license", VERSIONED),
        Rule("public-domain", "(?:in|into|to) the public <domain", NAME),
        Rule("public-domain", "public <domain dedication", VERSIONED),
        Rule("ogl", "open <government licen[cs]e(?: v ?[123](?: 0)?)?", VERSIONED),
        Rule("fair-source", "<fair source license", NAME),
        Rule("proprietary", "<proprietary and confidential", VERSIONED),
        Rule("proprietary", "<unauthorized (?:copying|use|distribution|reproduction)", NAME),
        Rule("proprietary", f"<proprietary {LICENSE}", NAME),
        Rule("no-reuse", "may not be <reproduced(?: distributed| stored| copied| or| in| any| form){0,8} without(?: the)?(?: prior)?(?: express)?(?: written)? permission", NOTICE),
        Rule("no-reuse", "no part of this (?:publication|book|work|document) may be <reproduced", NOTICE),
        Rule("some-rights", "some rights <reserved", NAME),
        Rule("copyright", "<copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", HINT),
        Rule("copyright", "c <copyright (?:19|20)[0-9][0-9]", HINT),
        Rule("spdx", "<spdx license identifier", HINT),
        Rule("see-license", "see (?:the )?(?:file )?<(?:license|licence|copying)(?: txt| md)?(?: file)? for", HINT),
        Rule("licensed", "<(?:licensed|licenced) under", HINT),
    ]


#: Phrases whose every place is counted, and which other rules can't suppress (fixed by the query's contract).
BASE = [
    Rule("cc-by", "<cc by", HINT, base=True),
    Rule("gpl", "general <public license", HINT, base=True),
    Rule("reserved", "all rights <reserved", HINT, base=True),
]

RULES: list[Rule] = [*BASE, *_creative_commons(), *_gnu(), *_versioned(), *_bsd(), *_others()]
