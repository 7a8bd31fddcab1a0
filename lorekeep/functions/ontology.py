"""The default ontology: classes, predicates and noise fields of encyclopaedic infoboxes, as plain tables."""

from __future__ import annotations

from lorekeep.operators.extract import Ontology, Predicate

PEOPLE = ("Person", "Scholar", "Companion", "Imam", "Prophet")

#: Class | infobox templates that assert it.
CLASSES = """
Scholar | infobox shia scholar, infobox shia scholar without socio-political activities
Companion | infobox companion of imam (a), infobox sahaba
Imam | infobox imam
Prophet | infobox prophets, infobox prophet muhammad (s)
Person | infobox person, infobox narrator, infobox ruler, infobox artist, infobox descendant of imam, infobox descedant of imam, infobox lady fatimah al-zahra' (a)
Book | infobox book
Sura | infobox sura
Verse | infobox verse
Hadith | infobox hadith
Supplication | infobox supplication and ziyara text
Ritual | infobox rituals
Building | infobox religious building
Place | infobox city, infobox country
Battle | infobox war, infobox event
Family | infobox family
Organization | infobox shia organization, infobox website
Film | infobox film
"""

#: Fixed values but for the phrases, which are ours: predicate | phrase | fields | inverse | range or classes of objects (PEOPLE: any person) | classes of subjects.
PREDICATES = """
taught_by | learnt from | professors, professor, teachers | taught
taught | instructed | students | taught_by
ijaza_from | had leave to transmit from | permission for hadith transmission from, permission for ijtihad from, permission to narrate from | ijaza_to
ijaza_to | gave leave to transmit to | permission for hadith transmission to | ijaza_from
narrated_by | comes down through | narrator, narrators, main narrator, narrated by
narrated_from | passed on reports of | narrated from, narrated from infallible
companion_of | kept company with | companion of
relative_of | was kin to | well known relatives, well-known relatives, wellknown relatives
father | was fathered by | father | child | PEOPLE
mother | was born to | mother | child | PEOPLE
spouse | was wed to | spouse(s), spouses, husband, wife | spouse
child | was a parent of | sons, daughters, son(s), daughter(s), children, descendants | parent
parent | was a child of | | child
sibling | shared parents with | brothers, sisters | sibling
descends_from | traces its line to | lineage
contemporary_of | lived at the time of | contemporary with, contemporary rulers, contemporary prophet | contemporary_of
born_in | came into the world in | place of birth, birthplace, birth place
died_in | passed away in | place of martyrdom
buried_at | rests at | burial place, place of burial, graveyards
resided_in | made a home in | place of residence, places of residence, residence, home town, hometown
studied_in | went to study in | place of study, places of study
migrated_to | moved to | migration to
born_on | has the birth date | birth, born, birthday | | date
died_on | has the death date | death, death/martyrdom, martyrdom, demise | | date
cause_of_death | lost life through | cause of death, cause of death/martyrdom, cause of martyrdom
affiliation | was counted among | religious affiliation, religion, muhajir/ansar
authored | is the author of | works | authored_by | Book, Supplication, Hadith
known_for | is remembered for | known for, notable roles, role
participated_in | had a part in | activities, other activities, socio-political activities, scholarly activities, presence at ghazwas, important events, important rites
authored_by | has as its author | author, writer | authored | PEOPLE
published_by | was brought out by | publisher, en publisher, english publisher
translated_by | was put into another language by | translator, translated by
about_subject | deals with | subject, topic, about, genre, hadith topics
in_sura | stands in | sura | | Sura | Verse
revealed_at | came down at | place of revelation
revealed_because | came down on account of | cause of revelation
related_verse | has a kindred verse in | related verses, others | related_verse
revelation_type | has the place of revelation type | makki/madani
issued_by | goes back to | issued by
source_shia | has the Shia source | shi'a sources
source_sunni | has the Sunni source | sunni sources
monograph | is treated in the book | monographs
observed_at | is kept at the time of | time
combatant | had as a fighting side | combatant1, combatant2
commander | had as a leader | commander1, commander2
occurred_at | happened at | place, location
occurred_on | happened on | date | | date
caused_by | arose from | cause
part_of | forms part of | part of
located_in | lies in | country, province
founded_by | owes its founding to | founder, architect
founded_on | dates from | established, year of foundation | | date
contains | holds | shrines, mosques, historical places, husayniyyas, seminary, facilities, research centers, institutes, capital, shi'a areas
related_event | goes with the event | related events
published_on | appeared in | published, pub date | | date
imamate_began | led as imam from | beginning of imamate | | date
converted_on | became a Muslim in | converting to islam, conversion to islam | | date
reigned | ruled in | reign | | date
renovated_on | was rebuilt in | renovation | | date
has_type | is a kind of | type, types, status
chain_validity | has a chain judged as | validity of the chain of transmission, reliability
resulted_in | led to | result
in_era | falls in the time of | era
opposed_by | had as opponents | enemies
supported_by_verse | rests on the verse | qur'anic support
member | includes | figures, scholars, head, rulers
originates_from | stems from | origin
succeeded_by | was followed by | successor, after | preceded_by
preceded_by | came after | predecessor, before | succeeded_by
"""

#: Fields that state no relation.
NOISE = """
image, image size, imagesize, image flag, alt, caption, caption image, signature, logo, logo caption, width, emblem,
photo, pic, picture, align, float, box width, url, website, official website, isbn, page, pages, volumes,
name, full name, official name, local name, main title, title, title orig, original title, old name, other names, nickname,
epithet, teknonym, kunya, well known as, note, en title, orig lang code, series, language, runtime, background,
coordinates, coordinate, casualties1, casualties2, strength1, strength2, sequential number, repeat in the qur'an, verse count,
word count, letter count, verse number, word number, letter number, sura number, revelation number, juz, juz', number of hadiths,
population, total population, muslim population, shi'a population, area, capacity, titles, duration of imamate, age,
percentage to the country's population
"""

#: Predicates by priority; all others have 3.
PRIORITY = [
    "authored_by authored taught_by taught companion_of issued_by in_sura father mother child spouse sibling commander combatant",
    "narrated_by narrated_from source_shia source_sunni buried_at born_in died_in occurred_at succeeded_by preceded_by relative_of descends_from",
    "about_subject known_for participated_in contains revealed_at revealed_because related_verse",
]
#: Predicates that may end a path but not carry it on, and symmetric ones that have no inverse.
NO_TRANSIT = "resided_in affiliation born_in buried_at studied_in died_in occurred_at migrated_to revealed_at located_in in_era has_type revelation_type chain_validity about_subject known_for".split()
SYMMETRIC = ["relative_of", "companion_of"]


def _listed(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.replace("\n", " ").split(",") if x.strip())


def _predicate(line: str) -> Predicate:
    name, label, fields, inverse, objects, subjects = ([p.strip() for p in line.split("|")] + [""] * 4)[:6]
    rank = next((i for i, names in enumerate(PRIORITY) if name in names.split()), 3)
    classes = PEOPLE if objects == "PEOPLE" else () if objects == "date" else _listed(objects)
    return Predicate(name, label, _listed(fields), "date" if objects == "date" else "entity", inverse or None, _listed(subjects), classes, rank)


def default() -> Ontology:
    classes = {c.strip(): _listed(t) for c, _, t in (line.partition("|") for line in CLASSES.strip().splitlines())}
    return Ontology(classes, tuple(_predicate(line) for line in PREDICATES.strip().splitlines()), _listed(NOISE), tuple(SYMMETRIC))
