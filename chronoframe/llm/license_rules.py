"""The signature rules of the license scan, by hand: label, priority, keywords, pattern.

Patterns run on lower-cased text; a rule is tried only where one of its keywords stands in the text, so
keywords are parts that every match has unbroken (none holds a gap, or a spelling where the pattern allows others). ``~``
in a pattern is any run of white space and comment marks. Higher priority wins where detections overlap; the order breaks ties.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


GAP = r"[\s*#/;%-]+"


def _r(label: str, priority: int, keywords: str, pattern: str) -> Rule:
    return Rule(label, priority, tuple(keywords.split("|")), pattern.replace("~", GAP))


# explicit tags
TAGS = [
    _r("tag", 90, "spdx-license-identifier", r"spdx-license-identifier:\s*[(a-z0-9][a-z0-9.+() -]{1,80}"),
    _r("tag", 85, "spdx-filecopyrighttext", r"spdx-filecopyrighttext:[^\n]{1,120}"),
    _r("tag", 70, "license:", r"\blicense:\s*(?:mit|isc|apache-?2(?:\.0)?|bsd(?:-[234]-clause)?|[al]?gpl-?[23](?:\.0)?(?:-only|-or-later|\+)?|mpl-?2(?:\.0)?|unlicense|cc0|zlib|wtfpl)\b"),
    _r("tag", 70, "license", r"\blicense\s*=\s*[\"']?(?:mit|isc|apache-?2(?:\.0)?|bsd(?:-[234]-clause)?|[al]?gpl-?[23](?:\.0)?(?:-only|-or-later|\+)?|mpl-?2(?:\.0)?|unlicense|cc0|zlib|wtfpl)\b"),
    _r("tag", 70, "licence:", r"\blicence:\s*(?:mit|isc|apache-?2(?:\.0)?|bsd|[al]?gpl-?[23]|mpl-?2(?:\.0)?|unlicense|cc0|zlib)\b"),
    _r("tag", 60, "module_license", r"module_license\s*\(\s*\"[^\"]{1,40}\"\s*\)"),
    _r("tag", 60, "license-file", r"license-file\s*[:=]\s*\S{1,60}"),
    _r("tag", 60, "approved", r"license~::~osi~approved(?:~::~[a-z0-9 .()+-]{2,60})?"),
]

# GNU family
GNU = [
    _r("agpl-3.0", 80, "affero", r"gnu~affero~general~public~license(?:[, ]~?version~3|~v\.?~?3)?"),
    _r("agpl-3.0", 78, "agpl", r"\bagpl[- ]?v?\.?3(?:\.0)?(?:\+|-only|-or-later)?\b"),
    _r("agpl-1.0", 79, "affero", r"affero~general~public~license~(?:version~|v)1\b"),
    _r("agpl", 50, "agpl", r"\bagpl\b"),
    _r("lgpl-2.0", 80, "library", r"gnu~library~general~public~license(?:[, ]~?version~2)?"),
    _r("lgpl-2.1", 82, "lesser", r"gnu~lesser~general~public~license[^.]{0,40}version~2\.1"),
    _r("lgpl-3.0", 82, "lesser", r"gnu~lesser~general~public~license[^.]{0,40}version~3"),
    _r("lgpl", 75, "lesser", r"gnu~lesser~general~public~licen[cs]e"),
    _r("lgpl-2.1", 78, "lgpl", r"\blgpl[- ]?v?\.?2\.1(?:\+|-only|-or-later)?"),
    _r("lgpl-3.0", 78, "lgpl", r"\blgpl[- ]?v?\.?3(?:\.0)?(?:\+|-only|-or-later)?\b"),
    _r("lgpl-2.0", 77, "lgpl", r"\blgpl[- ]?v?\.?2(?:\.0)?(?:\+|-only|-or-later)?\b"),
    _r("lgpl", 50, "lgpl", r"\blgpl\b"),
    _r("gpl-2.0", 74, "general", r"gnu~general~public~license[^.]{0,60}version~2\b"),
    _r("gpl-3.0", 74, "general", r"gnu~general~public~license[^.]{0,60}version~3\b"),
    _r("gpl-1.0", 74, "general", r"gnu~general~public~license[^.]{0,60}version~1\b"),
    _r("gpl", 60, "general", r"(?:gnu~)?general~public~licen[cs]e"),
    _r("gpl-2.0", 70, "gpl", r"\bgpl[- ]?v?\.?2(?:\.0)?(?:\+|-only|-or-later)?\b"),
    _r("gpl-3.0", 70, "gpl", r"\bgpl[- ]?v?\.?3(?:\.0)?(?:\+|-only|-or-later)?\b"),
    _r("gpl-1.0", 70, "gpl", r"\bgpl[- ]?v?\.?1(?:\.0)?(?:\+|-only|-or-later)?\b"),
    _r("gpl", 40, "gpl", r"\bgpl(?:'?ed)?\b"),
    _r("gpl", 72, "redistribute", r"redistribute~it~and/or~modify~it~under~the~terms~of~the~gnu"),
    _r("gpl", 55, "www.gnu.org", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl[-\w.]*"),
    _r("lgpl", 56, "www.gnu.org", r"https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl[-\w.]*"),
    _r("agpl", 56, "www.gnu.org", r"https?://www\.gnu\.org/licenses/agpl[-\w.]*"),
    _r("gfdl-1.3", 80, "documentation", r"gnu~free~documentation~license[^.]{0,40}version~1\.3"),
    _r("gfdl-1.2", 80, "documentation", r"gnu~free~documentation~license[^.]{0,40}version~1\.2"),
    _r("gfdl-1.1", 80, "documentation", r"gnu~free~documentation~license[^.]{0,40}version~1\.1"),
    _r("gfdl", 70, "documentation", r"(?:gnu~)?free~documentation~license"),
    _r("gfdl", 60, "gfdl", r"\bgfdl\b"),
    _r("gpl-exception", 81, "classpath", r"classpath~exception"),
    _r("gpl-exception", 81, "runtime", r"gcc~runtime~library~exception"),
    _r("gpl-exception", 81, "exception", r"font~exception"),
    _r("gpl-exception", 81, "exception", r"(?:static|openssl)?~?linking~exception"),
    _r("gpl-exception", 81, "autoconf", r"autoconf~(?:configure~script~)?exception"),
    _r("gpl-exception", 81, "bison", r"bison~exception"),
    _r("copyleft-next", 70, "copyleft-next", r"copyleft-next(?:~?0\.3\.[01])?"),
]

# permissive licenses
PERMISSIVE = [
    _r("mit", 75, "licence|license", r"\b(?:the~)?mit~licen[cs]e\b"),
    _r("mit", 74, "permission", r"permission~is~hereby~granted,~free~of~charge,~to~any~person~obtaining~a~copy"),
    _r("mit", 73, "substantial", r"shall~be~included~in~all~copies~or~substantial~portions~of~the~software"),
    _r("mit", 60, "opensource.org", r"opensource\.org/licenses?/mit\b"),
    _r("mit-0", 80, "mit", r"\bmit(?:~no~attribution|-0)\b"),
    _r("mit", 55, "expat", r"\bexpat~licen[cs]e\b"),
    _r("x11", 75, "consortium|x11", r"\bx11~licen[cs]e\b|x~consortium~shall~not~be~used"),
    _r("isc", 75, "isc", r"\bisc~licen[cs]e\b"),
    _r("isc", 74, "permission", r"permission~to~use,~copy,~modify,~and(?:/or)?~distribute~this~software~for~any~purpose~with~or~without~fee"),
    _r("0bsd", 80, "zero-clause|0bsd", r"\b(?:bsd~)?zero-clause~bsd\b|\b0bsd\b"),
    _r("apache-2.0", 80, "apache", r"apache~licen[cs]e[, ]~?(?:version~)?2(?:\.0)?"),
    _r("apache-1.1", 80, "software", r"apache~software~licen[cs]e[, ]~?(?:version~)?1\.1"),
    _r("apache-1.0", 79, "1.0|group", r"apache~license[, ]~?(?:version~)?1\.0|developed~by~the~apache~group"),
    _r("apache-2.0", 70, "www.apache.org", r"www\.apache\.org/licenses/license-2\.0"),
    _r("apache", 60, "apache", r"apache~(?:software~)?licen[cs]e"),
    _r("apache-2.0", 65, "apache-2|apache 2", r"\bapache[- ]2(?:\.0)?\b"),
    _r("bsd-2-clause", 80, "bsd", r"\b(?:simplified~bsd|freebsd~licen[cs]e|bsd[- ]2[- ]clause|2[- ]clause~bsd)"),
    _r("bsd-3-clause", 80, "bsd", r"\b(?:new~bsd|modified~bsd|revised~bsd|bsd[- ]3[- ]clause|3[- ]clause~bsd)"),
    _r("bsd-4-clause", 80, "bsd", r"\b(?:original~bsd|bsd[- ]4[- ]clause|4[- ]clause~bsd)"),
    _r("bsd-3-clause", 76, "endorse", r"may~be~used~to~endorse~or~promote~products~derived~from"),
    _r("bsd-4-clause", 77, "advertising", r"all~advertising~materials~mentioning~features~or~use~of~this~software"),
    _r("bsd", 70, "redistribution", r"redistribution~and~use~in~source~and~binary~forms"),
    _r("bsd", 55, "bsd", r"\bbsd(?:-style)?~licen[cs]ed?\b"),
    _r("zlib", 75, "zlib", r"\bzlib(?:/libpng)?~licen[cs]e\b"),
    _r("zlib", 74, "software", r"the~origin~of~this~software~must~not~be~misrepresented"),
    _r("libpng", 75, "libpng", r"\blibpng~licen[cs]e\b"),
    _r("bsl-1.0", 75, "boost", r"boost~software~licen[cs]e"),
    _r("bsl-1.0", 60, "boost.org", r"boost\.org/license_1_0"),
    _r("unlicense", 75, "unlicense", r"\b(?:the~)?unlicense\b"),
    _r("unlicense", 76, "domain", r"free~and~unencumbered~software~released~into~the~public~domain"),
    _r("wtfpl", 75, "want|wtfpl", r"\bwtfpl\b|do~what~the~f\w+~you~want~to~public~license"),
    _r("ncsa", 75, "ncsa", r"university~of~illinois/?~?ncsa~open~source~license|\bncsa~licen[cs]e\b"),
    _r("postgresql", 75, "postgresql", r"\bpostgresql~licen[cs]e\b"),
    _r("python-2.0", 75, "psf|python", r"python~software~foundation~licen[cs]e|\bpsf~licen[cs]e\b"),
    _r("python-2.0", 55, "cnri", r"\bcnri~(?:python~)?licen[cs]e"),
    _r("php-3.01", 75, "php", r"\bphp~licen[cs]e(?:[, ]~?version~3\.0?1?)?"),
    _r("ruby", 75, "ruby", r"\bruby(?:'s)?~licen[cs]e\b"),
    _r("artistic-2.0", 80, "artistic", r"artistic~licen[cs]e[, ]~?(?:version~)?2(?:\.0)?"),
    _r("artistic-1.0", 79, "artistic", r"artistic~licen[cs]e[, ]~?(?:version~)?1(?:\.0)?"),
    _r("artistic", 70, "artistic", r"(?:perl~)?artistic~licen[cs]e"),
    _r("openssl", 75, "openssl", r"\bopenssl~(?:and~ssleay~)?licen[cs]e\b|developed~by~the~openssl~project"),
    _r("ssleay", 75, "ssleay|young", r"\bssleay~licen[cs]e\b|written~by~eric~young"),
    _r("curl", 75, "curl", r"\bcurl~licen[cs]e\b"),
    _r("vim", 75, "licence|license", r"\bvim~licen[cs]e\b"),
    _r("icu", 75, "icu", r"\bicu~licen[cs]e\b"),
    _r("unicode-dfs", 75, "unicode", r"unicode,?~inc\.?~licen[cs]e~agreement|unicode~data~files~and~software"),
    _r("w3c", 75, "w3c", r"\bw3c~software~(?:notice~and~)?licen[cs]e"),
    _r("afl-3.0", 75, "academic", r"academic~free~licen[cs]e(?:[, ]~?(?:version~|v\.?~?)3\.0)?"),
    _r("ecl-2.0", 75, "educational", r"educational~community~licen[cs]e"),
    _r("upl-1.0", 75, "permissive", r"universal~permissive~licen[cs]e"),
    _r("blueoak-1.0.0", 75, "blue", r"blue~oak~model~licen[cs]e"),
    _r("mulanpsl-2.0", 75, "mulan", r"mulan~(?:permissive~software~licen[cs]e|psl)"),
    _r("ofl-1.1", 75, "open", r"(?:sil~)?open~font~licen[cs]e"),
    _r("ofl-1.1", 60, "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    _r("beerware", 75, "ware", r"\bbeer-?ware\b"),
    _r("hpnd", 72, "historical", r"historical~permission~notice~and~disclaimer"),
    _r("fair", 70, "fair", r"\bfair~licen[cs]e\b"),
    _r("naist", 70, "naist|technology", r"nara~institute~of~science~and~technology|\bnaist~licen[cs]e\b"),
    _r("intel", 70, "intel", r"\bintel~open~source~licen[cs]e\b"),
    _r("xnet", 70, "x.net", r"\bx\.net~licen[cs]e\b"),
    _r("tcl", 70, "tcl", r"\btcl(?:/tk)?~licen[cs]e\b"),
    _r("sleepycat", 75, "sleepycat", r"\bsleepycat~(?:software~)?licen[cs]e\b"),
    _r("bzip2", 70, "bzip2", r"\bbzip2~licen[cs]e\b"),
    _r("imagemagick", 70, "imagemagick", r"\bimagemagick~licen[cs]e\b"),
    _r("ijg", 70, "independent", r"independent~jpeg~group"),
    _r("info-zip", 70, "info-zip", r"\binfo-zip~licen[cs]e\b"),
    _r("json", 75, "good,", r"shall~be~used~for~good,~not~evil"),
    _r("mirOS", 70, "miros", r"\bmiros~licen[cs]e\b"),
    _r("latex-lppl", 75, "project", r"latex~project~public~licen[cs]e"),
]

# weak copyleft and vendors
RECIPROCAL = [
    _r("mpl-2.0", 80, "mozilla", r"mozilla~public~licen[cs]e[, ]~?(?:version~|v\.?~?)2(?:\.0)?"),
    _r("mpl-1.1", 80, "mozilla", r"mozilla~public~licen[cs]e[, ]~?(?:version~|v\.?~?)1\.1"),
    _r("mpl-1.0", 79, "mozilla", r"mozilla~public~licen[cs]e[, ]~?(?:version~|v\.?~?)1\.0"),
    _r("mpl", 70, "mozilla", r"mozilla~public~licen[cs]e"),
    _r("mpl-2.0", 60, "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0"),
    _r("mpl", 50, "mpl", r"\bmpl[- ]?v?[12](?:\.[01])?\b"),
    _r("epl-2.0", 80, "eclipse", r"eclipse~public~licen[cs]e(?:[, ]|~-)~?(?:version~|v\.?~?)2(?:\.0)?"),
    _r("epl-1.0", 79, "eclipse", r"eclipse~public~licen[cs]e(?:[, ]|~-)~?(?:version~|v\.?~?)1(?:\.0)?"),
    _r("epl", 70, "eclipse", r"eclipse~public~licen[cs]e"),
    _r("edl-1.0", 75, "distribution", r"eclipse~distribution~licen[cs]e"),
    _r("cpl-1.0", 70, "common", r"common~public~licen[cs]e"),
    _r("ipl-1.0", 70, "ibm", r"ibm~public~licen[cs]e"),
    _r("cddl-1.1", 80, "development", r"common~development~and~distribution~licen[cs]e[^.]{0,30}1\.1"),
    _r("cddl-1.0", 75, "development", r"common~development~and~distribution~licen[cs]e"),
    _r("cddl", 60, "cddl", r"\bcddl\b"),
    _r("eupl-1.2", 80, "european", r"european~union~public~licen[cs]e[^.]{0,20}1\.2"),
    _r("eupl", 70, "eupl|european", r"european~union~public~licen[cs]e|\beupl\b"),
    _r("cecill-2.1", 80, "cecill", r"\bcecill[- ]?(?:version~|v)?2\.1\b"),
    _r("cecill-b", 80, "cecill-b", r"\bcecill-b\b"),
    _r("cecill-c", 80, "cecill-c", r"\bcecill-c\b"),
    _r("cecill", 70, "cecill", r"\bcecill\b"),
    _r("ms-pl", 75, "microsoft|ms-pl", r"microsoft~public~licen[cs]e|\bms-pl\b"),
    _r("ms-rl", 75, "ms-rl|reciprocal", r"microsoft~reciprocal~licen[cs]e|\bms-rl\b"),
    _r("osl-3.0", 75, "software", r"open~software~licen[cs]e(?:[, ]~?(?:version~|v\.?~?)3\.0)?"),
    _r("qpl-1.0", 75, "public", r"\bq~public~licen[cs]e\b"),
    _r("apsl-2.0", 75, "apple", r"apple~public~source~licen[cs]e"),
    _r("npl-1.1", 75, "netscape", r"netscape~public~licen[cs]e"),
    _r("nposl-3.0", 75, "non-profit", r"non-profit~open~software~licen[cs]e"),
    _r("rpl-1.5", 75, "reciprocal", r"reciprocal~public~licen[cs]e"),
    _r("rpsl-1.0", 75, "realnetworks", r"realnetworks~public~source~licen[cs]e"),
    _r("spl-1.0", 75, "sun", r"\bsun~public~licen[cs]e\b"),
    _r("sissl", 75, "industry", r"sun~industry~standards~source~licen[cs]e"),
    _r("watcom-1.0", 75, "sybase", r"sybase~open~watcom~public~licen[cs]e"),
    _r("nokia", 75, "nokia", r"nokia~open~source~licen[cs]e"),
    _r("motosoto", 75, "motosoto", r"motosoto~open~source~licen[cs]e"),
    _r("lucent-1.02", 75, "lucent", r"lucent~public~licen[cs]e"),
    _r("oclc-2.0", 75, "oclc", r"oclc~research~public~licen[cs]e"),
    _r("nasa-1.3", 75, "nasa", r"nasa~open~source~agreement"),
    _r("oset", 75, "oset", r"\boset~(?:foundation~)?public~licen[cs]e\b"),
    _r("odbl-1.0", 80, "database|odbl", r"open~(?:data~commons~)?~?open~database~licen[cs]e|open~database~licen[cs]e|\bodbl\b"),
    _r("odc-by-1.0", 80, "attribution|odc-by", r"open~data~commons~attribution~licen[cs]e|\bodc-by\b"),
    _r("pddl-1.0", 80, "dedication", r"public~domain~dedication~and~licen[cs]e"),
    _r("cdla-permissive", 80, "community", r"community~data~license~agreement[ -]+permissive"),
    _r("cdla-sharing", 80, "community", r"community~data~license~agreement[ -]+sharing"),
]

# Creative Commons
CC = [
    _r("cc-by-nc-nd", 88, "cc by nc nd|cc by nc-nd|cc by-nc nd|cc by-nc-nd|cc-by nc nd|cc-by nc-nd|cc-by-nc nd|cc-by-nc-nd", r"\bcc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.0)?"),
    _r("cc-by-nc-sa", 88, "cc by nc sa|cc by nc-sa|cc by-nc sa|cc by-nc-sa|cc-by nc sa|cc-by nc-sa|cc-by-nc sa|cc-by-nc-sa", r"\bcc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.0)?"),
    _r("cc-by-nc", 86, "by-nc|by nc", r"\bcc[- ]by[- ]nc(?:[- ][1-4]\.0)?"),
    _r("cc-by-nd", 86, "by-nd|by nd", r"\bcc[- ]by[- ]nd(?:[- ][1-4]\.0)?"),
    _r("cc-by-sa", 86, "by-sa|by sa", r"\bcc[- ]by[- ]sa(?:[- ][1-4]\.0)?"),
    _r("cc-by", 80, "cc by|cc-by", r"\bcc[- ]by(?:[- ][1-4]\.0)?\b"),
    _r("cc0", 85, "cc0", r"\bcc0(?:[- ]1\.0)?\b"),
    _r("cc-by-nc-nd", 87, "noncommercial", r"attribution-?~?noncommercial-?~?noderiv(?:ative)?s?(?:~[1-4]\.0)?"),
    _r("cc-by-nc-sa", 87, "noncommercial", r"attribution-?~?noncommercial-?~?share-?alike(?:~[1-4]\.0)?"),
    _r("cc-by-nc", 84, "noncommercial", r"attribution-?~?noncommercial(?:~[1-4]\.0)?"),
    _r("cc-by-nd", 84, "attribution", r"attribution-?~?noderiv(?:ative)?s?(?:~[1-4]\.0)?"),
    _r("cc-by-sa", 84, "alike", r"attribution-?~?share-?~?alike(?:~[1-4]\.0)?"),
    _r("cc-by", 78, "creative", r"creative~commons~attribution(?:~[1-4]\.0)?(?:~international|~unported|~generic)?(?:~public)?(?:~licen[cs]e)?"),
    _r("cc0", 85, "creative", r"creative~commons~zero"),
    _r("cc", 60, "creative", r"creative~commons"),
    _r("cc-by-nc-nd", 87, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.0"),
    _r("cc-by-nc-sa", 87, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.0"),
    _r("cc-by-nc", 86, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[1-4]\.0"),
    _r("cc-by-nd", 86, "creativecommons.org", r"creativecommons\.org/licenses/by-nd/[1-4]\.0"),
    _r("cc-by-sa", 86, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[1-4]\.0"),
    _r("cc-by", 85, "creativecommons.org", r"creativecommons\.org/licenses/by/[1-4]\.0"),
    _r("cc0", 86, "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    _r("public-domain", 85, "creativecommons.org", r"creativecommons\.org/publicdomain/mark"),
]

# restrictive terms, models and data
RESTRICTED = [
    _r("sspl-1.0", 80, "side|sspl", r"server~side~public~licen[cs]e|\bsspl\b"),
    _r("busl-1.1", 80, "business|busl", r"business~source~licen[cs]e|\bbusl(?:-1\.1)?\b"),
    _r("elastic-2.0", 80, "elastic", r"\belastic~licen[cs]e(?:~2\.0)?\b"),
    _r("commons-clause", 80, "commons", r"\bcommons~clause\b"),
    _r("confluent", 75, "community", r"confluent~community~licen[cs]e"),
    _r("polyform", 80, "polyform", r"\bpolyform~(?:noncommercial|small~business|shield|perimeter|strict|free~trial|internal~use)\b"),
    _r("polyform", 70, "polyform", r"\bpolyform\b"),
    _r("parity", 75, "parity", r"parity~public~licen[cs]e"),
    _r("prosperity", 75, "prosperity", r"prosperity~public~licen[cs]e"),
    _r("hippocratic", 75, "hippocratic", r"hippocratic~licen[cs]e"),
    _r("anti-996", 75, "anti 996|anti-996", r"anti[- ]996~licen[cs]e"),
    _r("openrail", 80, "openrail|responsible", r"\bopenrail(?:-?\+{0,2}m?)?\b|responsible~ai~licen[cs]e"),
    _r("llama", 75, "llama", r"\bllama~[234](?:\.\d)?~community~licen[cs]e"),
    _r("gemma", 75, "gemma", r"\bgemma~terms~of~use\b"),
    _r("proprietary", 75, "confidential", r"proprietary~and~confidential|confidential~and~proprietary"),
    _r("proprietary", 70, "proprietary", r"\bproprietary~licen[cs]e\b|this~software~is~proprietary"),
    _r("proprietary", 70, "secret", r"\btrade~secrets?~of\b"),
    _r("proprietary", 70, "copying", r"unauthori[sz]ed~copying~of~this~(?:file|software|document)"),
    _r("proprietary", 65, "reproduced", r"may~not~be~reproduced[^.]{0,80}without~(?:the~)?(?:prior~|express~|written~)+(?:permission|consent)"),
    _r("proprietary", 65, "written", r"without~(?:the~)?prior~written~(?:permission|consent)"),
    _r("eula", 75, "end user|end-user|eula", r"end[- ]user~licen[cs]e~agreement|\beula\b"),
    _r("noncommercial", 60, "commercial", r"\b(?:for~)?non-?commercial~(?:use|purposes)~only\b"),
    _r("noncommercial", 60, "personal", r"\b(?:for~)?personal~use~only\b"),
    _r("noncommercial", 60, "educational", r"\b(?:for~)?educational~(?:use|purposes)~only\b"),
    _r("noncommercial", 60, "research", r"\b(?:for~)?research~(?:use|purposes)~only\b"),
    _r("noncommercial", 60, "commercial", r"\bnot~for~commercial~use\b"),
    _r("no-training", 75, "train", r"may~not~be~used~(?:to~train|for~training)~(?:[a-z]+~){0,3}(?:models?|systems?|ai)\b"),
    _r("no-training", 75, "mining", r"text~and~data~mining~(?:is~)?(?:not~permitted|reserved|prohibited)"),
    _r("evaluation", 65, "evaluation", r"\b(?:for~)?evaluation~(?:use|purposes)~only\b"),
    _r("freeware", 60, "freeware", r"\bfreeware\b"),
    _r("shareware", 60, "shareware", r"\bshareware\b"),
]

# notices
NOTICES = [
    _r("reserved", 80, "reserved", r"\ball~rights~reserved\b"),
    _r("reserved", 78, "droits", r"\btous~droits~r[ée]serv[ée]s\b"),
    _r("reserved", 78, "rechte", r"\balle~rechte~vorbehalten\b"),
    _r("reserved", 78, "derechos", r"\btodos~los~derechos~reservados\b"),
    _r("reserved", 78, "diritti", r"\btutti~i~diritti~riservati\b"),
    _r("reserved", 78, "direitos", r"\btodos~os~direitos~reservados\b"),
    _r("reserved", 70, "some", r"\bsome~rights~reserved\b"),
    _r("public-domain", 78, "domain", r"\b(?:in(?:to)?~the~|is~)?public~domain\b"),
    _r("public-domain", 80, "dedicated", r"dedicated~to~the~public~domain"),
    _r("public-domain", 76, "reserved", r"\bno~rights~reserved\b"),
    _r("copyright", 50, "copyright", r"\bcopyright~(?:\(c\)|©)?~?(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)?\d\d)*(?:~[^\n]{1,60})?"),
    _r("copyright", 48, "©", r"©\s*(?:19|20)\d\d[^\n]{0,60}"),
    _r("copyright", 47, "(c)", r"\(c\)\s*(?:19|20)\d\d[^\n]{0,60}"),
    _r("copyright", 45, "copyright", r"\bcopyright~(?:holders?|owners?)\b"),
    _r("warranty", 40, "provided", r"provided~[\"“']?as~is[\"”']?"),
    _r("warranty", 40, "warranty", r"without~(?:any~)?warranty(?:~of~any~kind)?"),
    _r("warranty", 40, "merchantability", r"merchantability~(?:and|or)~fitness~for~a~particular~purpose"),
    _r("warranty", 40, "event", r"in~no~event~shall~[^.]{0,120}be~liable"),
    _r("warranty", 38, "harmless", r"indemnify~(?:and~)?hold~harmless"),
    _r("patent", 45, "patent", r"\bpatent~(?:licen[cs]e|grant)\b"),
    _r("patent", 44, "pending", r"\bpatents?~pending\b"),
    _r("trademark", 45, "trademark", r"\b(?:registered~)?trademarks?~of\b"),
    _r("trademark", 44, "trademarks", r"trademarks~are~the~property~of~their~(?:respective~)?owners"),
    _r("license-ref", 30, "details|more", r"see~(?:the~)?(?:file~)?licen[cs]e(?:\.txt|\.md)?~(?:file~)?for~(?:details|more)"),
    _r("license-ref", 30, "licenced|licensed", r"\blicen[cs]ed~under~(?:the~)?(?:terms~of~)?(?:the~)?[^.\n]{3,60}"),
    _r("license-ref", 28, "terms", r"under~the~terms~of~(?:the|this)~[^.\n]{3,60}licen[cs]e"),
    _r("license-ref", 28, "dual licenced|dual licensed|dual-licenced|dual-licensed", r"\bdual[- ]licen[cs]ed\b"),
    _r("license-ref", 28, "subject", r"subject~to~the~(?:licen[cs]e|terms)\b"),
    _r("terms", 40, "terms", r"\bterms~of~use\b"),
    _r("terms", 40, "service", r"\bterms~of~service\b"),
    _r("terms", 38, "conditions", r"\bterms~and~conditions\b"),
]

RULES: list[Rule] = [*TAGS, *GNU, *PERMISSIVE, *RECIPROCAL, *CC, *RESTRICTED, *NOTICES]
