"""Closed vocabularies: states, grades, tags, countries and institution types with their spellings."""

from __future__ import annotations

_STATES = """AK Alaska|AL Alabama|AR Arkansas|AZ Arizona|CA California|CO Colorado|CT Connecticut|DE Delaware|FL Florida|GA Georgia
|HI Hawaii|IA Iowa|ID Idaho|IL Illinois|IN Indiana|KS Kansas|KY Kentucky|LA Louisiana|MA Massachusetts|MD Maryland|ME Maine|MI Michigan
|MN Minnesota|MO Missouri|MS Mississippi|MT Montana|NC North Carolina|ND North Dakota|NE Nebraska|NH New Hampshire|NJ New Jersey
|NM New Mexico|NV Nevada|NY New York|OH Ohio|OK Oklahoma|OR Oregon|PA Pennsylvania|RI Rhode Island|SC South Carolina|SD South Dakota
|TN Tennessee|TX Texas|UT Utah|VA Virginia|VT Vermont|WA Washington|WI Wisconsin|WV West Virginia|WY Wyoming"""

#: Lower-case name to code.
STATES: dict[str, str] = {part.strip()[3:].lower(): part.strip()[:2] for part in _STATES.split("|")}
#: Longest names first; equally long ones by the alphabet.
STATES_LONGEST_FIRST = sorted(STATES.items(), key=lambda s: (-len(s[0]), s[0]))

_HIGH = ["Freshman", "Sophomore", "Junior", "Senior"]
ELEMENTARY = ["Kindergarten", *(f"Grade {n}" for n in range(1, 9))]
SCHOOL = ELEMENTARY[1:] + [f"High School {y}" for y in _HIGH]
GRADES = [
    *ELEMENTARY,
    *(f"High School {y}" for y in [*_HIGH, "Graduate", "Student"]),
    *(f"College {y}" for y in _HIGH),
    "Undergraduate",
    *(f"{kind} Student" for kind in ("Community College", "Vocational or Trade", "Graduate", "Doctoral", "Law", "Medical")),
    "Not Currently Enrolled",
]

_GRADE_KEYS: dict[str, str] = {
    "Kindergarten": "k kindergarten",
    "High School Student": "high-school high-school-student",
    "High School Graduate": "high-school-graduate",
    **{f"High School {y}": f"high-school-{y.lower()}" for y in _HIGH},
    **{f"College {y}": f"{y.lower()} college-{y.lower()}" for y in _HIGH[1:]},
    "College Freshman": "freshman college-freshman incoming-freshman college-freshman-attended-college-previously",
    "Undergraduate": "undergraduate undergraduate-student college college-student postsecondary-student post-secondary-student "
    "nth-year-college-undergraduate 5th-year-college-undergraduate",
    "Graduate Student": "graduate-student graduate",
    "Doctoral Student": "doctoral-student doctoral doctoral-candidate ph-d phd",
    "Community College Student": "community-college-student community-college-sophomore community-college-freshman "
    "community-college-freshman-attended-college-previously",
    "Vocational or Trade Student": "vocational-or-trade-student vocational-student",
    "Law Student": "postgraduate-law-school law-student",
    "Medical Student": "postgraduate-medical-school medical-student",
    "Not Currently Enrolled": "on-academic-break not-currently-enrolled not-enrolled",
}
#: Slug to grades.
GRADE_ALIASES: dict[str, list[str]] = {slug: [grade] for grade, slugs in _GRADE_KEYS.items() for slug in slugs.split()} | {"k-8": ELEMENTARY}

_TAG_KEYS = {
    "financial-need": "need-based low-income low-income-preference income-limited",
    "underrepresented": "hbcu bipoc underrepresented-minority",
    "cancer-affected": "cancer-survivors cancer-survivor",
    "black-students": "black-student black",
    "adult-learners": "adult-learner",
    "arts": "drawing",
    "business": "entrepreneur",
    "community-service": "community-involvement",
    "disability": "disabled",
    "education": "future-teachers",
    "future-teachers": "future-teacher",
    "healthcare": "latino-health",
    "nursing": "nurse",
    "stem": "stem-fields",
    "women": "woman",
}
#: Slug to tag; one hop only, so "future-teacher" stops at "future-teachers".
TAG_ALIASES: dict[str, str] = {slug: tag for tag, slugs in _TAG_KEYS.items() for slug in slugs.split()}

COUNTRY_ALIASES = {"USA": "US", "UNITED STATES OF AMERICA": "US", "UNITED STATES": "US", "UNITED KINGDOM": "GB", "CANADA": "CA", "MEXICO": "MX", "PUERTO RICO": "PR"}
INSTITUTION_TYPES = {"four-year": "Four-year", "two-year": "Two-year", "vocational": "Vocational"}
GENERIC_TITLE_WORDS = sorted({w for word in ("application", "award", "fund", "grant", "program", "scholarship") for w in (word, f"{word}s")})
NO_DEADLINE = "9999-12-31"
PUBLICATION = ("archived", "draft", "published")
VETTING = ("ai", "human", "unvetted")
#: Array fields of eligibility that the editing search text covers, in its order.
SEARCHED_ARRAYS = tuple(
    "countries states counties cities regions grades degreeLevels fields citizenship tags other institutions institutionDesignations".split()
) + tuple("employers unions tribes organizations medicalConditions exactCriteria".split())
