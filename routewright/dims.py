"""Dimension rows the text and category operators need."""

from __future__ import annotations

# Fixed values: (city, country) gazetteer, in list order; list order breaks length ties.
CITIES = [
    ("ST ALBANS", "United Kingdom"), ("MILTON KEYNES", "United Kingdom"), ("HERTFORDSHIRE", "United Kingdom"),
    ("HEMEL HEMPSTEAD", "United Kingdom"), ("WATFORD", "United Kingdom"), ("LUTON", "United Kingdom"),
    ("HARPENDEN", "United Kingdom"), ("STEVENAGE", "United Kingdom"),
    ("LONDON", "United Kingdom"), ("MANCHESTER", "United Kingdom"), ("LIVERPOOL", "United Kingdom"),
    ("BIRMINGHAM", "United Kingdom"), ("LEEDS", "United Kingdom"), ("BRISTOL", "United Kingdom"),
    ("EDINBURGH", "United Kingdom"), ("GLASGOW", "United Kingdom"), ("CARDIFF", "United Kingdom"),
    ("BRIGHTON", "United Kingdom"), ("OXFORD", "United Kingdom"), ("CAMBRIDGE", "United Kingdom"),
    ("YORK", "United Kingdom"), ("BATH", "United Kingdom"),
    ("AMSTERDAM", "Netherlands"), ("ROTTERDAM", "Netherlands"), ("UTRECHT", "Netherlands"),
    ("PARIS", "France"), ("BERLIN", "Germany"), ("MUNICH", "Germany"), ("HAMBURG", "Germany"),
    ("MADRID", "Spain"), ("BARCELONA", "Spain"), ("ROME", "Italy"), ("MILAN", "Italy"),
    ("VIENNA", "Austria"), ("PRAGUE", "Czechia"), ("WARSAW", "Poland"), ("STOCKHOLM", "Sweden"),
    ("OSLO", "Norway"), ("COPENHAGEN", "Denmark"), ("HELSINKI", "Finland"), ("DUBLIN", "Ireland"),
    ("LISBON", "Portugal"), ("BRUSSELS", "Belgium"), ("ZURICH", "Switzerland"),
    ("NEW YORK", "United States"), ("LOS ANGELES", "United States"), ("SAN FRANCISCO", "United States"),
    ("CHICAGO", "United States"), ("BOSTON", "United States"), ("SEATTLE", "United States"),
    ("PORTLAND", "United States"), ("AUSTIN", "United States"), ("DENVER", "United States"),
    ("MIAMI", "United States"), ("TORONTO", "Canada"), ("VANCOUVER", "Canada"), ("MONTREAL", "Canada"),
    ("TOKYO", "Japan"), ("OSAKA", "Japan"), ("KYOTO", "Japan"), ("SEOUL", "South Korea"),
    ("SHANGHAI", "China"), ("BEIJING", "China"), ("HONG KONG", "Hong Kong"), ("SINGAPORE", "Singapore"),
    ("BANGKOK", "Thailand"), ("SYDNEY", "Australia"), ("MELBOURNE", "Australia"), ("BRISBANE", "Australia"),
    ("PERTH", "Australia"), ("AUCKLAND", "New Zealand"), ("WELLINGTON", "New Zealand"),
]

# Words that never name a place in a title's last part.
NON_PLACES = """
big small happy sad official national morning evening afternoon sunday monday tuesday wednesday
thursday friday saturday fast slow quick long short the and or of in on with for
run ride jog walk art strava doodle today yesterday tomorrow new old good bad best
first last year day week month fun cool
""".split()

# Category slugs.
CATEGORIES = """
animation birds burbing cats-dogs dinosaurs elephants fiction food-drink geography hearts holidays insects
mammals misc people plants reptiles sea-life shapes snails sport transport words-numbers
""".split()

# Search terms of each category slug.
CATEGORY_TERMS = {
    "cats-dogs": "cat cats kitty kitten dog dogs puppy puppies doggo yorkie labrador poodle pet pets",
    "birds": "bird birds owl duck chicken rooster penguin parrot swan flamingo eagle",
    "dinosaurs": "dinosaur dinosaurs dino trex t-rex raptor stegosaurus",
    "elephants": "elephant elephants",
    "mammals": "mammal mammals horse pig cow sheep lion tiger bear rabbit bunny mouse rat fox wolf deer "
               "kangaroo monkey giraffe squirrel",
    "insects": "insect insects bug bugs bee butterfly ant spider ladybug",
    "reptiles": "reptile reptiles snake lizard turtle tortoise crocodile alligator gecko",
    "sea-life": "fish shark whale dolphin octopus crab lobster seahorse jellyfish sealife sea-life ocean",
    "snails": "snail snails slug",
    "plants": "plant plants flower tree leaf",
    "hearts": "heart love valentine",
    "holidays": "christmas santa easter halloween pumpkin",
    "people": "person people face stickman",
    "transport": "car bike bicycle plane boat ship train",
    "sport": "ball football soccer basketball",
    "food-drink": "food drink pizza burger beer coffee cake icecream ice-cream",
    "shapes": "shape shapes star circle square",
    "misc": "misc",
}

SYNONYMS = {term: slug for slug, terms in CATEGORY_TERMS.items() for term in terms.split()}

# Street-type words that end a name, with their long form.
TRAILING_STREET_WORDS = {
    "rd": "road", "road": "road", "st": "street", "street": "street",
    "ave": "avenue", "av": "avenue", "avenue": "avenue", "ln": "lane", "lane": "lane",
    "dr": "drive", "drive": "drive", "blvd": "boulevard", "boulevard": "boulevard",
    "cl": "close", "close": "close", "cres": "crescent", "cr": "crescent", "crescent": "crescent",
    "ct": "court", "court": "court", "pl": "place", "place": "place", "sq": "square", "square": "square",
    "way": "way", "walk": "walk", "park": "park", "green": "green", "hill": "hill",
    "gdns": "gardens", "gardens": "gardens", "mews": "mews", "terrace": "terrace", "ter": "terrace",
    "row": "row", "path": "path", "rise": "rise",
}

# Street-type words that begin a name.
LEADING_STREET_WORDS = "rue calle avenida plaza via viale piazza".split()

# Street-type endings glued to the name, with their long form.
GLUED_STREET_ENDINGS = {"strasse": "strasse", "straße": "strasse"}

# Inclusive hue bands (0..180 scale) of drawn strokes.
STROKE_HUE_BANDS = [(0, 20), (160, 180), (140, 165), (10, 25)]

# Display names of the known shapes.
SHAPE_METADATA = [
    ("pig", "Pig", "🐷", "curly tail, ear bump, two wide legs"),
    ("cat", "Cat", "🐱", "twin pointed ears, tail curling up over back"),
    ("dog", "Dog", "🐶", "floppy ear, long snout, longer body"),
    ("dino", "Dino", "🦖", "three back spikes, long tapering tail"),
    ("chicken", "Chicken", "🐔", "three-peak comb, beak, layered tail feathers"),
]
