"""Small word lists of our own for generated text."""

WOMEN = "Alma Berit Carmen Dalia Elif Freya Greta Hanna Ines Jana Kira Lena Mara Nadia Olga Petra Rosa Signe Tilda Vera".split()
MEN = "Anton Boris Carlos Dario Emil Felix Goran Henrik Ivan Jonas Karl Leon Marco Nils Oskar Pavel Rafael Stefan Tomas Viktor".split()
LAST = "Abbott Becker Castell Dorn Engel Falk Grund Haugen Iversen Jansen Keller Lindt Moreau Novak Orlov Petrov Quist Rossi Sandberg Torres Ulrich Vogel Weiss Xu Young Zeller".split()
WORDS = "amber basin cedar delta ember field grove harbor island juniper kernel lantern meadow nickel orchard pebble quartz river saddle timber upland valley willow yarrow zenith brisk calm dusk early faint gentle hollow ivory keen lively mellow narrow open plain quiet rapid steady tidy vivid warm".split()
PRODUCTS = "lamp chair kettle bicycle notebook jacket bottle clock basket blanket mirror shelf".split()
MATERIALS = "oak steel linen glass copper cotton".split()
COLORS = "red green blue yellow purple orange teal grey black white".split()
FIRMS = ["Group", "and Sons", "Works", "Partners", "Supply", "Labs"]
JOBS = ["Clerk", "Engineer", "Analyst", "Designer", "Planner", "Manager", "Technician", "Editor"]
LEVELS = ["Junior", "Senior", "Lead", "Chief"]
STREETS = ["Street", "Road", "Lane", "Avenue", "Court"]
COUNTRIES = ["Norway", "Kenya", "Chile", "Japan", "Italy", "Canada", "India", "Portugal", "United States"]
CURRENCIES = ["EUR", "USD", "JPY", "GBP", "SEK", "INR"]
ZONES = ["Europe/Oslo", "America/Lima", "Asia/Tokyo", "Africa/Nairobi", "Australia/Perth"]
DOMAINS = ["example.com", "example.net", "example.org"]
AGENTS = ["Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Macintosh)", "Mozilla/5.0 (Windows NT 10.0)"]
PERMISSIONS = ["read", "write", "delete", "share", "invite", "admin"]
SEXES = ["female", "male"]

#: For coherent places: a state's abbreviation, a ZIP code prefix (three digits) in use there, and cities in it.
STATES = {
    "AL": (350, ["Birmingham", "Mobile", "Huntsville"]),
    "AK": (995, ["Anchorage", "Juneau", "Fairbanks"]),
    "AZ": (850, ["Phoenix", "Tucson", "Mesa"]),
    "AR": (722, ["Little Rock", "Fayetteville", "Jonesboro"]),
    "CA": (900, ["Los Angeles", "San Diego", "Fresno"]),
    "CO": (802, ["Denver", "Aurora", "Boulder"]),
    "CT": (61, ["Hartford", "New Haven", "Stamford"]),
    "DE": (198, ["Wilmington", "Dover", "Newark"]),
    "DC": (200, ["Washington"]),
    "FL": (331, ["Miami", "Tampa", "Orlando"]),
    "GA": (303, ["Atlanta", "Macon", "Savannah"]),
    "HI": (968, ["Honolulu", "Hilo", "Kailua"]),
    "ID": (837, ["Boise", "Nampa", "Pocatello"]),
    "IL": (606, ["Chicago", "Peoria", "Joliet"]),
    "IN": (462, ["Indianapolis", "Fort Wayne", "Evansville"]),
    "IA": (503, ["Des Moines", "Davenport", "Dubuque"]),
    "KS": (672, ["Wichita", "Topeka", "Salina"]),
    "KY": (402, ["Louisville", "Lexington", "Paducah"]),
    "LA": (701, ["New Orleans", "Baton Rouge", "Shreveport"]),
    "ME": (41, ["Portland", "Bangor", "Augusta"]),
    "MD": (212, ["Baltimore", "Annapolis", "Frederick"]),
    "MA": (21, ["Boston", "Lowell", "Salem"]),
    "MI": (482, ["Detroit", "Flint", "Lansing"]),
    "MN": (554, ["Minneapolis", "Duluth", "Rochester"]),
    "MS": (392, ["Jackson", "Biloxi", "Tupelo"]),
    "MO": (631, ["Saint Louis", "Kansas City", "Springfield"]),
    "MT": (591, ["Billings", "Missoula", "Helena"]),
    "NE": (681, ["Omaha", "Lincoln", "Kearney"]),
    "NV": (891, ["Las Vegas", "Reno", "Elko"]),
    "NH": (31, ["Manchester", "Nashua", "Concord"]),
    "NJ": (71, ["Newark", "Trenton", "Camden"]),
    "NM": (871, ["Albuquerque", "Santa Fe", "Roswell"]),
    "NY": (100, ["New York", "Albany", "Buffalo"]),
    "NC": (282, ["Charlotte", "Durham", "Raleigh"]),
    "ND": (581, ["Fargo", "Bismarck", "Minot"]),
    "OH": (432, ["Columbus", "Toledo", "Dayton"]),
    "OK": (731, ["Oklahoma City", "Tulsa", "Norman"]),
    "OR": (972, ["Portland", "Salem", "Eugene"]),
    "PA": (191, ["Philadelphia", "Erie", "Scranton"]),
    "RI": (29, ["Providence", "Newport", "Warwick"]),
    "SC": (292, ["Columbia", "Charleston", "Greenville"]),
    "SD": (571, ["Sioux Falls", "Rapid City", "Pierre"]),
    "TN": (381, ["Memphis", "Nashville", "Knoxville"]),
    "TX": (752, ["Dallas", "Austin", "Houston"]),
    "UT": (841, ["Salt Lake City", "Provo", "Ogden"]),
    "VT": (54, ["Burlington", "Montpelier", "Rutland"]),
    "VA": (232, ["Richmond", "Norfolk", "Roanoke"]),
    "WA": (981, ["Seattle", "Tacoma", "Spokane"]),
    "WV": (253, ["Charleston", "Huntington", "Wheeling"]),
    "WI": (532, ["Milwaukee", "Madison", "Green Bay"]),
    "WY": (820, ["Cheyenne", "Casper", "Laramie"]),
}
