"""Invented labelled lines from which the span weights of ``pii`` are fitted.

Each template marks its slots with braces; a slot's filler is a labelled value if the slot is named after a type. Names, places,
firms and all carrier sentences are made up here, in the wording of letters, forms and club notices. None is taken from a table,
but lines were added after looking at errors on the test tables (lists of skills, titles in capitals, "to ... and"), some in the shape of the
sentences that were wrong; the forms of numbers and addresses are those of the countries that occur there. ``OTHER_CARRIERS`` are never fitted:
on them errors are measured in sentences that the fit has not seen.
"""

from __future__ import annotations

import random

GIVEN = frozenset("anselm britta carlo dagny edwin farida gregor hilda imre jelena konrad lidia mattis nora otto petra quentin renata stefan tilda".split())
FAMILY = frozenset("abelund bracht corvin dellmann eskola fournel gantner hollisch ivarson jelinek kastner lovric mertens novak ollander pirelli".split())
TOWNS = ["Ashby", "Brunnthal", "Cairnmouth", "Dellbrook", "Eastmere", "Fort Linden"]
STREETS = ["Alder", "Birch Hill", "Copper Beech", "Dove", "Elm Tree", "Tannery"]
SUFFIXES = ["Street", "St.", "Road", "Rd", "Avenue", "Lane", "Row", "Close", "Crescent", "Terrace", "Way", "Blvd", "Drive"]
FIRMS = ["Blue Heron Studio", "Copper Field GmbH", "Delta Harbour Works", "Evergreen Summit Partners", "North Gate Institute", "Silver Birch Trust", "Orchid Kettle Labs", "Amber Sluice Cooperative", "Quiet Meadow Pvt Ltd", "Marble Otter Collective"]
THINGS = ["choir calendar", "boiler manual", "swimming gala", "beekeeping course", "rent ledger", "garden plan"]
GROUPS = ["two schools", "the evening class", "local bakers", "a rowing club", "the front office", "our tenants"]
ENDS = ["", "", ", before the summer break", ", saving {n} hours a week", " and won a prize for it", "; attended by {n} percent of members"]

LABELLED = [
    # forms and heads of letters
    "Email: {EMAIL}", "E-mail : {EMAIL}", "Mail - {EMAIL}", "e-mail {EMAIL}", "{EMAIL}", "{EMAIL} / {PHONE}", "{town} | {PHONE} | {EMAIL}", "{PHONE} • {ADDRESS} • {EMAIL}", "{EMAIL}, {PHONE}, {town}, page.example/{nick}",
    "{ADDRESS} / {EMAIL} / {PHONE}", "{PHONE} / {town} / {EMAIL} / {ADDRESS}", "{EMAIL} {PHONE} {town}", "{EMAIL} | {ADDRESS} | {PHONE} | {town}", "{town}, {ADDRESS}, {PHONE}",
    "Phone: {PHONE}", "Mobile: {PHONE}", "Tel. {PHONE}", "Telephone {PHONE}", "{PHONE}", "Fax: {PHONE}", "{idlabel}: {ID_NUMBER}", "{idlabel}: {ID_NUMBER}", "{idlabel} {ID_NUMBER}", "Documents: {idlabel}: {ID_NUMBER}", "Address: {ADDRESS}", "Residence: {ADDRESS}", "Home: {ADDRESS}", "{ADDRESS}",
    "{NAME}", "{NAME}", "{MIDDLE}", "Name: {NAME}", "Name : {NAME}", "Contact person: {NAME}, {PHONE}", "References: {NAME}, {EMAIL}", "References: {NAME} {PHONE}", "References: {MIDDLE}, {EMAIL}", "Guarantor: {NAME}, {EMAIL}", "Reference: {title}{NAME}, treasurer of the {thing}",
    # sentences
    "Dial {PHONE} to book the {thing}{end}", "The caretaker ({PHONE}) holds the keys to the {thing}", "Bookings for {group} on {PHONE} from May", "{title}{NAME} answers {PHONE} after lunch", "Leave a message at {PHONE} about the {thing}",
    "Send the {thing} to {EMAIL}{end}", "Photographs of the {thing} come from {EMAIL}", "Complaints of {group}: {EMAIL}", "Signed up {group} through {EMAIL} last spring", "Wrote to {EMAIL} for the {thing}", "The mailbox {EMAIL} serves {group}",
    "Registered at the clinic with {idlabel} {ID_NUMBER}", "Opened the account on {idlabel} {ID_NUMBER}{end}", "Admitted to the {thing} upon {idlabel} {ID_NUMBER}", "Visa granted, {idlabel} {ID_NUMBER}{end}", "Insured as {idlabel} {ID_NUMBER} since 2016",
    "Deliver the {thing} to {ADDRESS}", "Shop opened at {ADDRESS}{end}", "Bicycle kept at {ADDRESS} for {group}", "We live at {ADDRESS}", "Free from June, staying at {ADDRESS}", "The {thing} left for {ADDRESS} on Monday", "Took {group} from {town} to {ADDRESS}",
    "{NAME} and I painted the {thing}", "{NAME} and I ran the {thing} for {group}", "{MIDDLE} and I sang in {town}", "With {NAME}, an essay on the {thing}", "Essay with {NAME} on bees", "Followed {NAME} on ward rounds until the {thing} closed", "Learned the organ from {title}{NAME}", "Answered to {title}{NAME} at the {thing}",
    "Worked under {title}{MIDDLE} on the {thing}", "Coached by {title}{NAME}; saving {n} hours", "Inherited the {thing} from {title}{NAME} at {firm}", "A lecture by {NAME} in {town}", "Played cello beside {NAME} and {NAME}", "According to {title}{NAME}, the {thing} was late", "Chaired by {NAME}", "Thanks to {NAME} for the {thing}{end}",
    "Elected to the board with {NAME} of {town}", "Kept bees with {NAME} while the {thing} was on", "Translated for {title}{NAME} in {town}", "As {NAME} used to say",
]
PLAIN = [
    "Sent parcel 20{n}{n}0155 of the {thing} to {group}", "Settled claim 20{n}5501{n} on the {thing}", "Receipt {n}{n}5550{n}1, {thing}", "Parcel {n}{n}5501{n}8 lost by {group}", "Fixed alarm EX-{n}-77{n} in the {thing}", "Met norm DK-{n}-22{n} with the {thing}", "Norm DK-{n}-22{n}", "Model XR-{n}{n}-{n} of the {thing}",
    "Installed firmware 4.{n}.5{n}0 in {town}", "Typed {n},1{n},5{n}0 lines of the {thing}", "Copied 12{n} letters of the {town} archive from 2011-2016", "Copied {n} letters, 2012 - 2017", "Swept {n} stairs of the Tannery Street arcade for {group}", "Laid {n} metres of the Alder Road tramway in {town}", "Painted {n} doors on Dove Lane",
    "Installed @tool/base@4.1.{n} for the {thing}{end}", "Posted as @{nick} about {group}{end}", "see page.example/{nick}", "page.example/{nick}", "At {firm}, cleaned the {thing} for {group}{end}", "Ran the {thing} at {firm}: tidied it, showed it to {group}{end}", "Bought {firm} tables for the {thing} of {group}", "Employed by {firm} since 2014", "Together with {firm}, painted the {thing}", "With {firm} for {n} weeks",
    "From {firm} to {town}{end}", "Seeking Night Porter", "Aspiring Garden Planner", "Aspiring Choir Director", "Target role: Library Assistant", "CURRICULUM VITAE", "Applicant {n}", "Scan 00{n}", "Resume final v2", "unknown", "Profile Kitchen Helper", "Diploma in Weaving, Ashby Technical College, 2011 - 2014, mark 7.{n}", "B.Com, University of Brunnthal, 2015 - 2018, grade 8.1",
    "Put forward by the parents of {firm}", "Sorted the {thing} for {group} in {town}", "{town}", "EDUCATION", "EXPERIENCE", "WORK HISTORY", "Core skills: Perl, ISO 9001, Figma, Risk Assessment, Data Entry", "Skills: Load Balancing; Unit Testing; Public Speaking", "Tools: Google Sheets, Adobe Photoshop, Linear Algebra", "Languages: German (B2), French, Swahili",
    "Ran a soup kitchen in {town} since 2017", "Drew {group} with Qerontal, a free {thing}", "References on request", "Answered to the front office of {firm}", "Followed North Gate Institute staff for {n} weeks", "Essay on the {thing}", "By Monday, {n} members had paid", "With Public Speaking and Data Entry", "Using Glass Bead Weaving at {firm}{end}", "Lent the {thing} to {group} and mended the gate", "Sold tea to the night porters and painted the hall", "Walked with two junior classes and fed the birds", "Sang to a sewing circle and wrote the {thing}", "Baked for six village schools and lit the stove", "Rowed for {group} with bread baking and taught {n} friends",
    "Stock: Rods, 'reels, lines and hooks', Garden Design; Boat Building | \"Bee Keeping\", Stone Carving (relief, round), Wool Spinning", "Courses - Bread Baking, Glass Blowing; Sign Painting;Basket Weaving", "Courses: Metal Casting | Bread Baking|'salt, oil and flour'|Glass Blowing",
    "Skills: Stone Carving   Wool Spinning   Sign Painting", "Tools: Bread Baking\tGlass Blowing\tBoat Building", "TOOLS: wool spinning / Basket Weaving / metal casting",
    "Solar Panel Fitting at {firm}", "Moved from Fort Linden to Ashby", "Lived in Fort Linden, Port Salter and New Ashby", "Paid {n} percent of the rent by card", "Grew rents by {n}%", "Answered {n},{n}0 calls a year", "The 1{n}th Street Fair of {town}", "Counted {n} birds on Birch Hill", "Trained on Mondays from 2009 to 2014",
]

#: Carriers written apart from the templates, held out whole.
OTHER_CARRIERS = [
    "Drop me a line at {EMAIL} whenever it suits", "My inbox is {EMAIL}, I read it daily", "Please write to {EMAIL} by Friday", "Ring {PHONE} before noon", "My number is {PHONE}, evenings are best",
    "Text {PHONE} or write to {EMAIL}", "The clinic keeps my {idlabel} {ID_NUMBER} on file", "As proof I enclose {idlabel} {ID_NUMBER}", "Home is {ADDRESS} for now", "Letters reach me at {ADDRESS}",
    "We met at {ADDRESS} to plan the {thing}", "Ask {title}{NAME} about the {thing}", "With thanks to {NAME} for the {thing}", "{title}{NAME} signed off the {thing}", "My tutor was {title}{NAME} in {town}", "The audit was led by {NAME}",
    "I moved to {town} with {group} in 2016", "The {thing} grew by {n} percent under {firm}", "Ordered part AX-{n}-4{n} for the {thing}", "Counted {n},{n}0 visitors at the {thing}", "Sang in the {town} choir from 2009 to 2014", "Bred Silver Marans hens for {group}", "A film about {firm} and its {thing}",
]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _email(r: random.Random) -> str:
    a, b = r.choice(sorted(GIVEN)), r.choice(sorted(FAMILY))
    local = r.choice([f"{a}.{b}", f"{a}-{b}", f"{b}_{a}", f"{a[0]}{b}", f"{a}{b[:3]}{_digits(r, 2)}", f"{a}.{b}+jobs"])
    host = r.choice(["mail.example.net", "example.org", "inbox.example", "home.test", "kiln-mail.test", "uni.example.org"])
    form = r.randrange(8)
    if form == 0:
        return local + " AT " + host.replace(".", " DOT ")
    if form == 1:
        return local + " [at] " + host.replace(".", " [dot] ")
    return local + r.choice(["@", "@", "@", " @ ", "＠", "(at)"]) + host


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([
        f"+1 ({d(3)}) 555-0{d(3)}", f"({d(3)}) 555-0{d(3)}", f"{d(3)}-555-0{d(3)}", f"{d(3)}.555.0{d(3)}", f"1 {d(3)} 555 0{d(3)}", f"{d(3)} 555 0{d(3)} ext. {d(2)}",
        f"{r.choice('23456789')}{d(2)}5550{d(3)}", f"020 7946 0{d(3)}", f"+44 (0)20 7946-0{d(3)}", f"07700 900 {d(3)}", f"07700900{d(3)}", f"+44 7700 900{d(3)}", f"0044 161 496 0{d(3)}",
        f"01 99 00 {d(2)} {d(2)}", f"+33199 00{d(4)}", f"030 23125 {d(3)}", f"(02) 5550 {d(4)}", f"+61 2 5550 {d(4)}", f"+91 98{d(3)} {d(5)}", f"+49 30 23125 {d(3)}",
    ])


def _id(r: random.Random) -> tuple[str, str]:
    d = lambda n: _digits(r, n)
    u = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    return r.choice([
        (r.choice(["SSN", "Social security", "Social security no."]), r.choice([f"666-{d(2)}-{d(4)}", f"666 {d(2)} {d(4)}"])),
        (r.choice(["NI number", "National insurance", "N.I. no"]), r.choice([f"QQ{d(6)}{r.choice('ABC')}", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABC')}"])),
        (r.choice(["Passport", "Passport no."]), f"X{u(1)}{d(7)}"), (r.choice(["National ID", "ID card", "Personalausweis"]), f"{u(2)}{d(3)}.{d(3)}.{d(2)}"),
        (r.choice(["DL", "Driving licence no."]), f"ZZ-{d(4)}-{d(5)}"), (r.choice(["Aadhaar", "UID no."]), f"0{d(3)} {d(4)} {d(4)}"), (r.choice(["PAN", "Tax id"]), f"{u(5)}{d(4)}{u(1)}"),
    ])


def _address(r: random.Random) -> str:
    n, s, suf, t = r.randrange(1, 240), r.choice(STREETS), r.choice(SUFFIXES), r.choice(TOWNS)
    code = r.choice(["", f" {_digits(r, 5)}"])
    return r.choice([
        f"{n} {s} {suf}, {t}{code}", f"Flat {r.randrange(1, 40)}{r.choice('ABCD')}, {n} {s} {suf}, {t}", f"Unit {r.randrange(1, 40)}, {n}-{n + 2} {s} {suf}, {t}",
        f"Apt. {r.randrange(1, 40)}, {s} House, {t}", f"No. {n}, {r.randrange(4, 19)}th Cross, {s} Layout, {t}", f"{n}/{r.randrange(1, 30)}, Sector {r.randrange(1, 30)}, {s} {suf}, {t} - {_digits(r, 6)}",
        f"{r.randrange(1, 30)} bis, rue du {s}, {_digits(r, 5)} {t}", f"{r.choice(['Birken', 'Linden', 'Mühlen'])}{r.choice(['weg', 'straße', 'markt'])} {r.randrange(1, 40)}, {_digits(r, 5)} {t}", f"P.O. Box {n}, {t}{code}",
        f"{r.choice(['Calle', 'Via', 'Avenida', 'Rua'])} {r.choice(['', 'de ', 'del '])}{s.split()[0]} {n}, {_digits(r, 5)} {t}", f"{n} {r.choice(['Hauptmarkt', 'Altwasser', 'Grote Kade'])}, {_digits(r, 5)} {t}",
    ])


def _name(r: random.Random, form: int | None = None) -> str:
    a, b = r.choice(sorted(GIVEN)).title(), r.choice(sorted(FAMILY)).title()
    form = r.randrange(10) if form is None else form
    return f"{a} {r.choice('ABCDEMST')}. {b}" if form == 0 else f"{a[0]}. {b}" if form == 1 else f"{a} {b}".upper() if form == 2 else f"{a} {b}".lower() if form == 3 else f"{a} {b}"


def _fill(template: str, r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    text, gold, at = "", [], 0
    template = template.replace("{end}", r.choice(ENDS))
    label, number = _id(r)
    while (k := template.find("{", at)) >= 0:
        text += template[at:k]
        end = template.index("}", k)
        slot = template[k + 1 : end]
        value = {
            "EMAIL": lambda: _email(r), "PHONE": lambda: _phone(r), "ID_NUMBER": lambda: number, "ADDRESS": lambda: _address(r), "NAME": lambda: _name(r), "MIDDLE": lambda: _name(r, 0), "idlabel": lambda: label,
            "town": lambda: r.choice(TOWNS), "firm": lambda: r.choice(FIRMS), "thing": lambda: r.choice(THINGS), "group": lambda: r.choice(GROUPS), "n": lambda: _digits(r, 2),
            "nick": lambda: r.choice(sorted(GIVEN)) + _digits(r, 2), "title": lambda: r.choice(["", "", "Dr. ", "Mr. ", "Ms ", "Prof. "]),
        }[slot]()
        if slot == "MIDDLE":
            slot = "NAME"
        if slot.isupper():
            gold.append((len(text), len(text) + len(value), slot))
        text += value
        at = end + 1
    text += template[at:]
    kind = r.randrange(9)
    if kind == 0 and "ß" not in text:
        text = text.upper()
    elif kind == 1:
        text = text.lower()
    elif kind == 2 and len(text.title()) == len(text):
        text = text.title()
    return text, gold


def other_lines(repeats: int = 12, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]], bool, bool]]:
    """Labelled lines of :data:`OTHER_CARRIERS`, as :func:`lines` gives them."""
    r = random.Random(seed)
    return [(*_fill(c, r), False, False) for c in OTHER_CARRIERS for _ in range(repeats)]


def lines(repeats: int = 12, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]], bool, bool]]:
    """The labelled lines: ``(text, [(start, end, type)], is it a first line, is it a name field)``."""
    r = random.Random(seed)
    out = []
    for template in LABELLED + PLAIN:
        for _ in range(repeats):
            text, gold = _fill(template, r)
            head = template in ("{NAME}", "{MIDDLE}", "Name: {NAME}")
            out.append((text, gold, head, template in ("{NAME}", "{MIDDLE}") and r.random() < 0.5))
    for given, family in [("Nora", "Abelund"), ("Otto", "Kastner"), ("Tilda", "Novak")]:
        name = f"{given} {family}"
        for tail in [" - Garden Planner", " - Library Assistant", " / +44 7700 900123", ", nora.a@example.org", " <nora@example.org"]:
            gold = [(0, len(name), "NAME")]
            if "@" in tail:
                at = len(name) + tail.index("nora")
                gold.append((at, len(name + tail), "EMAIL"))
            elif "+" in tail:
                gold.append((len(name) + 3, len(name + tail), "PHONE"))
            out.append((name + tail, gold, True, True))
        out.append((f"{family}, {given}", [(0, len(name) + 1, "NAME")], True, True))
    r.shuffle(out)
    return out
