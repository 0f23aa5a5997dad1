"""Ordered rule tables. In each, the first label that matches wins; keywords are lower-case letters and digits only."""

from __future__ import annotations


def _table(text: str) -> list[tuple[str, list[str]]]:
    rows = (line.split("<-") for line in text.strip().splitlines())
    return [(label.strip(), sorted(words.split())) for label, words in rows]


CATEGORY = _table("""
Pre-Roll <- cone cannagar blunt preroll
Vape <- 510 allinone atomizer cart cartridge disposable pod trupod trustik vape vaporizer
Capsule <- capsule gelcap gels softgel suppositor
Concentrate <- badder budder concentrate crumble dab diamond distillate extract hash isolate kief resin ricksimpson rosin rso sauce sauz shatter wax
Tincture <- nasal oral sublingual syringe tincture troche
Beverage <- beverage coffee drink seltzer soda tea tonic
Edible <- baked bar brownie candies candy chew chocolate cookie driedfruit edible gummi gummies gummy honey icecream lozenge mint snack spread
Topical <- balm cream intimate lotion lube patch rollon salve topical
Flower <- flower indoor mini moonrock outdoor shake smalls sungrown trim
Accessory <- accessor ancillary apparel battery charger clothing device gear gift grinder humidity knife lighter merch paper paraphernalia pipe rig rolling smoking tips vending wrap
""")

#: (label, keywords in the name, categories it may replace; "" is none).
CATEGORY_OVERRIDES = [
    ("Capsule", ["capsule", "gelcap", "protab", "softgel"], ["", "Concentrate", "Edible", "Other", "Tincture", "Topical"]),
    ("Capsule", ["suppositor"], ["", "Concentrate", "Edible", "Other", "Tincture", "Topical"]),
    ("Edible", ["troche"], ["", "Other", "Tincture"]),
    ("Flower", ["groundflower", "infusedflower"], ["", "Concentrate", "Other"]),
    ("Vape", ["aio", "allinone", "cartridge", "disposable"], ["", "Concentrate", "Other"]),
]

PRODUCT_TYPE = {
    "Vape": _table("""
Disposable <- aio allinone disposable
Pod <- pod
Cartridge <- 510 cart cartridge paxera vapepen
"""),
    "Concentrate": _table("""
Live Rosin <- liverosin
Live Resin <- liquidlive liveresin
Rosin <- rosin
Diamonds <- crystalline diamond thca
Sauce <- hcfse htfse sauce terpsauce
Sugar <- sugar
Badder/Budder <- badder budder
Shatter <- pullnsnap shatter
Wax <- honeycomb wax
Crumble <- crumble
Hash <- bubblehash drysift hash icewater templeball
Kief <- kief
RSO/Oil <- applicator feco ricksimpson rso syringe
Distillate <- distilate distillate
Isolate <- isolate
Moonrock <- moonrock
"""),
    "Edible": _table("""
Gummies <- fruitchew gummi gummies gummy pastille sour
Chocolate <- chocolate cocoa truffle
Baked Goods <- baked biscuit brownie cookie donut krispie muffin
Hard Candy <- caramel drops hardcandy lollipop lozenge taffy
Capsule <- capsule softgel
Troche <- troche
Drink Mix <- drinkmix elixir powder shot syrup
Mint <- breathmint mints
"""),
    "Flower": _table("""
Smalls <- littles popcorn smallbud smallflower smalls
Shake/Trim <- shake trim
Ground <- groundflower milled preground
Infused <- infused moonrock
Pre-Pack <- prepack prepackaged
"""),
    "Pre-Roll": _table("""
Infused <- hashhole infused
Blunt <- blunt cannagar
Pack <- pack
"""),
    "Beverage": _table("""
Soda/Seltzer <- carbonated seltzer soda sparkling
Tea <- tea
Coffee <- coffee coldbrew espresso
Lemonade/Juice <- juice lemonade
Tonic/Shot <- elixir shot tonic
Mix <- drinkmix powder
"""),
    "Tincture": _table("""
Spray <- spray
Sublingual <- dissolvable sublingual
Drops/Oral <- dropper drops oral syringe
RSO/FECO <- feco ricksimpson rso
"""),
    "Topical": _table("""
Lotion/Cream <- cream lotion moisturizer
Balm/Salve <- balm ointment salve
Patch <- patch transdermal
Lube/Intimate <- arousal intimate lube sensual
Roll-On <- roller rollon
Bath <- bath soak
Stick <- stick
"""),
    "Capsule": _table("""
Softgel <- gelcap gels softgel
Tablet <- tablet
Suppository <- suppositor
"""),
    "Accessory": _table("""
Battery <- battery charger
Grinder <- grinder
Paper/Cone <- cone papers rollingpaper
Pipe/Bong <- bong bowl bubbler dabber pipe rig
Lighter <- lighter torch
Storage <- bag container humidor jar pouch stash
Apparel <- apparel hat hoodie merch shirt sticker
"""),
}
PRODUCT_TYPE_DEFAULT = {"Capsule": "Capsule", "Flower": "Bud", "Pre-Roll": "Single"}
UNSPECIFIED = "Unspecified"

STRAIN = _table("""
CBD <- 10to1 1to1 20to1 2to1 5to1 cbd
Hybrid <- hybrid
Indica <- indica
Sativa <- sativa
""")

#: (label, keywords inside, whole words of the raw text).
OBTENTION = [
    ("Infused", sorted("badder batter coated covered distillate dusted infus moonrock shatter".split()), sorted("dab dabs kief powder rosin wax".split())),
    ("Extracted", ["cartridge", "syringe"], ["cart", "carts", "pod", "pods"]),
]

TERPENES = "Myrcene Limonene Caryophyllene Pinene Linalool Terpinolene Humulene Ocimene Bisabolol Guaiol Eudesmol".split()

OBSERVED_CATEGORIES = sorted("Beverage Capsule Concentrate Edible Flower Pre-Roll Tincture Topical Vape".split())
WEIGHT_CATEGORIES = ["Concentrate", "Flower", "Pre-Roll", "Vape"]

#: Words of a street address and their short forms.
ADDRESS_WORDS = dict(
    pair.split("=")
    for pair in """av=ave avenue=ave boulevard=blvd circle=cir court=ct drive=dr east=e fort=ft highway=hwy lane=ln mount=mt north=n
    northeast=ne northwest=nw parkway=pkwy place=pl road=rd route=rt rte=rt saint=st south=s southeast=se southwest=sw street=st
    terrace=ter west=w""".split()
)
UNIT_WORDS = "apartment apt bldg building fl floor rm room ste suite unit".split()

#: Street types and directions of the geocoders' keys.
STREET_TYPES = dict(
    pair.split("=")
    for pair in """AV=AVE AVE=AVE AVENUE=AVE BAY=BAY BLVD=BLVD BOULEVARD=BLVD CIR=CIR CIRCLE=CIR CIRCUIT=CIRCT CLOSE=CLOSE COMMON=COMMON
    COURT=CRT COVE=COVE CRES=CRES CRESCENT=CRES CRT=CRT CT=CRT DR=DR DRIVE=DR GATE=GATE GREEN=GREEN GROVE=GROVE HEIGHTS=HTS HIGHWAY=HWY
    HILL=HILL HTS=HTS HWY=HWY LANDING=LANDNG LANE=LANE LINK=LINK LN=LANE MANOR=MANOR MEWS=MEWS PARK=PARK PARKWAY=PKY PKWY=PKY PKY=PKY
    PL=PL PLACE=PL POINT=PT PT=PT RD=RD RIDGE=RIDGE RISE=RISE ROAD=RD SQ=SQ SQUARE=SQ ST=ST STREET=ST TER=TERR TERR=TERR TERRACE=TERR
    TRAIL=TRAIL TRL=TRAIL VIEW=VIEW VILLAS=VILLAS WAY=WAY""".split()
)
DIRECTIONS = dict(pair.split("=") for pair in "E=E EAST=E N=N NE=NE NORTH=N NORTHEAST=NE NORTHWEST=NW NW=NW S=S SE=SE SOUTH=S SOUTHEAST=SE SOUTHWEST=SW SW=SW W=W WEST=W".split())

#: Preference among platforms when rows of one store compete; the lower, the better.
MENU_RANK = {"cresco": 1, "curaleaf": 1, "dutchie": 0, "dutchie_plus": 0, "hytiva": 3, "jane": 2, "leafly": 9, "sweedpos": 1, "trulieve": 1, "weedmaps": 8}
MENU_RANK_OTHER = 5

GRAMS = dict((k, float(v)) for k, v in (pair.split("=") for pair in "g=1 gram=1 grams=1 lb=448 lbs=448 mg=0.001 milligram=0.001 milligrams=0.001 ounce=28 ounces=28 oz=28 pound=448".split()))
#: With one blank, or none.
SIZE_WORDS = {w.replace("_", j): float(g) for w, g in (pair.split("=") for pair in "eighth_ounce=3.5 half_gram=0.5 half_ounce=14 quarter_ounce=7 two_gram=2 eighth=3.5 gram=1 ounce=28 quarter=7".split()) for j in (" ", "")}

#: Name endings that say what a shop is, and those that say how it is incorporated.
SHOP_ENDINGS = [
    r"cannabis\s+dispensary", r"cannabis\s+shop", r"cannabis", r"dispensaries", r"dispensary", r"marijuana\s+dispensary", r"marijuana",
    r"marketplace", r"medical\s+cannabis\s+dispensary", r"medical\s+dispensary", r"medical\s+marijuana\s+dispensary",
]
LEGAL_ENDINGS = [
    r"co\.", r"company", r"corp\.?", r"corporation", r"enterprises?", r"group", r"holdings?", r"inc\.?", r"incorporated", r"investments?",
    r"l\.?l\.?c\.?", r"l\.?l\.?p\.?", r"limited", r"lp", r"ltd\.?", r"management", r"partners", r"properties", r"ventures?",
]
CONNECTORS = "& a and at by in of on the".split()
ARTICLES = ["a", "an", "the"]
PLACEHOLDER = "|".join(
    [r"\(flagged", r"\[equity retailer\]", r"\bdemo\b", r"\bdispensary name\b", r"\bdnu\b", r"\bdo not use\b", r"\bduplicate\b", r"\bsandbox\b",
     r"\btbd\b", r"\btest\b", "conditional license number", "data not available", "integrations lab"]
)
LICENCE = "|".join([r"\.cl\.[0-9]", r"^[0-9]{3}\.[0-9]{3}", r"^[0-9]{2,}[-0-9.]*(-cl)?$"])
