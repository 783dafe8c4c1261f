"""Fixed values of the scoring rules.

Everything in the FIXED VALUES block must keep these exact values for the
scores to mean what they mean; they are stated plainly, in natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (scoring rules)
# ---------------------------------------------------------------------------

# Population gate: areas below this many residents get no score.
MIN_POP = 100

# Safety axis: weights of the two crime groups, years pooled per group,
# and the empirical-Bayes prior strength in pseudo events.
SAFETY_WEIGHTS = {"serious": 0.65, "daily": 0.35}
SAFETY_YEARS = {"serious": 2, "daily": 1}
PRIOR_EVENTS = 2.0

# Crime groups of the safety axis, by the count columns of the crime table
# (fixed values): serious = violent + burglary, daily thefts, and the thefts
# that visitors suffer.
VIOLENT = ("凶悪犯強盗", "凶悪犯その他", "粗暴犯暴行", "粗暴犯傷害", "粗暴犯脅迫", "粗暴犯恐喝", "粗暴犯凶器準備集合")
BURGLARY = ("侵入窃盗空き巣", "侵入窃盗忍込み", "侵入窃盗居空き")
DAILY_THEFTS = ("非侵入窃盗自転車盗", "非侵入窃盗車上ねらい", "非侵入窃盗ひったくり", "非侵入窃盗すり", "非侵入窃盗置引き",
                "非侵入窃盗オートバイ盗", "非侵入窃盗自動車盗")
VISITOR_CRIMES = ("非侵入窃盗万引き", "非侵入窃盗置引き", "その他占有離脱物横領")
CRIME_TOTAL = "総合計"
# Served crime measures: output column -> the columns that it sums (fixed values).
CRIME_MEASURES = {
    "robbery": ("凶悪犯強盗",),
    "violence": ("粗暴犯暴行", "粗暴犯傷害", "粗暴犯脅迫", "粗暴犯恐喝"),
    "burglary": BURGLARY,
    "bicycle": ("非侵入窃盗自転車盗",),
    "vehicle": ("非侵入窃盗車上ねらい", "非侵入窃盗自動車盗", "非侵入窃盗オートバイ盗"),
    "snatch": ("非侵入窃盗ひったくり",),
    "pickpocket": ("非侵入窃盗すり",),
    "total": (CRIME_TOTAL,),
    "assault": ("粗暴犯暴行",),
    "injury": ("粗暴犯傷害",),
    "burglary_akisu": ("侵入窃盗空き巣",),
    "burglary_shinobi": ("侵入窃盗忍込み",),
    "burglary_izora": ("侵入窃盗居空き",),
}

# Business-area flag: visitor crimes per 1000 residents at or above this
# quantile of all gated areas.
BUSINESS_QUANTILE = 0.90

# Ground axis: representative value per boring class and prior strength
# (pseudo borings); an area with at most THIN_POINTS borings is "thin".
PL_WEIGHT_SMALL = 2.5
PL_WEIGHT_MID = 10.0
PL_WEIGHT_LARGE = 20.0
PRIOR_POINTS = 2.0
THIN_POINTS = 2

# National river depth rank -> (label, representative metres).
DEPTH_RANK = {
    1: ("0〜0.5m未満", 0.25),
    2: ("0.5〜3.0m未満", 1.75),
    3: ("3.0〜5.0m未満", 4.0),
    4: ("5.0〜10.0m未満", 7.5),
    5: ("10.0〜20.0m未満", 15.0),
    6: ("20.0m以上", 20.0),
}

# National rivers that the city flood data leaves out.
NATIONAL_RIVERS = ("荒川", "多摩川", "江戸川")
# Joiner of the river list and the labels of the two flood sources.
RIVER_LIST_SEPARATOR = "・"
BASIN_LIST_SEPARATOR = "|"
FLOOD_SOURCE_CITY = "東京都"
FLOOD_SOURCE_NATIONAL = "国管理河川"

# Score bucket borders and labels (good / average / check).
BUCKET_GOOD = 70
BUCKET_AVERAGE = 40
BUCKET_LABELS = ("良好", "平均的", "要確認")

# Typhoon-specific rule: flood at least this, tide at most that.
TYPHOON_FLOOD_MIN = 70
TYPHOON_TIDE_MAX = 30

# Served data year.
DATA_YEAR = 2025

# Batch writer limit in UTF-8 bytes.
MAX_BATCH_BYTES = 80_000

# Kanji numerals 1-9 and ten, as used in area names.
KANJI_DIGITS = "一二三四五六七八九"
KANJI_TEN = "十"

# Variant characters folded by the name normaliser (pairs: from, to).
NAME_VARIANTS = (("麴", "麹"), ("塚", "塚"), ("斉", "斎"))
# Small kana folded by the name normaliser.
NAME_KANA_FOLDS = (("ヶ", "ケ"), ("ノ", "の"))

# Columns that the type profiler always reports as TEXT.
FORCE_TEXT = ("key", "ward", "town", "ward_code", "kokusei_code",
              "shared_polygon_key", "nat_rivers", "nat_main_label",
              "nat_max_label", "flood_source", "flood_basin", "flood_basins")

# ---------------------------------------------------------------------------
# Fixture parameters (mapping of /root/testdata onto the engine's inputs)
# ---------------------------------------------------------------------------

CURRENT_YEAR = 2000
PREVIOUS_YEAR = 1999

# Zones: one L-shaped ring per nation, offset on a 5 x 5 lattice of 20 units.
ZONE_LATTICE = 5
ZONE_PITCH = 20.0
ZONE_RING = ((1, 1), (18, 2), (17, 9), (9, 10), (8, 19), (2, 18))

# Hazard triangle vertices relative to its anchor point.
HAZARD_TRIANGLE = ((0, 0), (9, 2), (3, 8))

# Area represented by one tide point in the fixture units.
FIXTURE_TIDE_CELL_AREA = 0.1

# Region keys whose zones the fixture treats as "out of tide scope".
FIXTURE_TIDE_OUT_REGIONS = (4,)

# ---------------------------------------------------------------------------
# FIXED VALUES (source code tables)
# ---------------------------------------------------------------------------

# Flood grid files are named shinsui_<slug>.csv; slug -> official basin label.
BASIN_FILE_PATTERN = r"^shinsui_(.+)\.csv$"
BASIN_LABELS = {
    "kandagawa": "神田川流域",
    "sumidagawa": "隅田川・新河岸川流域",
    "syakujiigawa": "石神井川・白子川流域",
    "nogawa": "野川・仙川・入間川・谷沢川・丸子川流域",
    "nakagawa": "中川・綾瀬川圏域",
    "koutounaibu": "江東内部河川流域",
    "jyounantiku": "城南地区河川流域（渋谷川・古川・目黒川・立会川・内川・呑川）",
}

# Boring class labels (as in the source attribute) in weight order.
PL_CLASS_SMALL = "小（0≦PL≦5）"
PL_CLASS_MID = "中（5<PL≦15）"
PL_CLASS_LARGE = "大（PL>15）"

# Fixture boring classes -> weights (the fixture uses plain class names).
FIXTURE_PL_WEIGHTS = {"small": PL_WEIGHT_SMALL, "mid": PL_WEIGHT_MID,
                      "large": PL_WEIGHT_LARGE}

# Grid cell size (fixture units) of the point-in-zone join.
FIXTURE_CELL = 2.0

# Overlay parameters (fixture units): x-slab width and bbox grid cell.
FIXTURE_SLAB = 5.0
FIXTURE_PAIR_CELL = 10.0
# Fixture hazard kinds of the collapse axis: river id -> kind.
FIXTURE_COLLAPSE_FLOW_RIVER = 0
FIXTURE_COLLAPSE_EROSION_RIVER = 1

# ---------------------------------------------------------------------------
# FIXED VALUES (area names)
# ---------------------------------------------------------------------------

# The 23 wards, in code order (ward code = 131 + two-digit position).
WARDS = ("千代田区", "中央区", "港区", "新宿区", "文京区", "台東区", "墨田区", "江東区",
         "品川区", "目黒区", "大田区", "世田谷区", "渋谷区", "中野区", "杉並区", "豊島区",
         "北区", "荒川区", "板橋区", "練馬区", "足立区", "葛飾区", "江戸川区")
# Wards outside the tide hazard map.
TIDE_OUT_OF_SCOPE = ("世田谷区", "渋谷区", "中野区", "杉並区", "豊島区", "練馬区")
# Rows of the crime table that are not areas.
EXCLUDE_CONTAINS = "計"
EXCLUDE_SUFFIX = "以下不詳"
BLOCK_SUFFIX = "丁目"
KEY_SEPARATOR = "|"

# Fixture wards: ward00 .. ward22 (zero padded so none prefixes another).
FIXTURE_WARD_COUNT = 23

# Area key -> polygon key where the boundary data names an area differently
# (renamed areas, undivided blocks, merged areas, variant characters).
POLYGON_ALIAS = {
    "千代田区|神田三崎町1丁目": "千代田区|三崎町1丁目",
    "千代田区|神田三崎町2丁目": "千代田区|三崎町2丁目",
    "千代田区|神田三崎町3丁目": "千代田区|三崎町3丁目",
    "千代田区|神田猿楽町1丁目": "千代田区|猿楽町1丁目",
    "千代田区|神田猿楽町2丁目": "千代田区|猿楽町2丁目",
    "千代田区|神田司町2丁目": "千代田区|神田司町",
    "千代田区|神田多町2丁目": "千代田区|神田多町",
    "千代田区|神田鍛冶町3丁目": "千代田区|神田鍛冶町",
    "大田区|令和島1丁目": "大田区|令和島",
    "大田区|令和島2丁目": "大田区|令和島",
    "新宿区|四谷1丁目": "新宿区|四谷",
    "新宿区|戸塚町1丁目": "新宿区|戸塚町",
    "足立区|入谷町": "足立区|入谷町,舎人町",
    "足立区|舎人町": "足立区|入谷町,舎人町",
    "渋谷区|松濤1丁目": "渋谷区|松涛1丁目",
    "渋谷区|松濤2丁目": "渋谷区|松涛2丁目",
}

# Fixture alias: zone 2 uses the polygon of zone 1; zone 24 has no polygon.
FIXTURE_ALIAS = {2: 1}
FIXTURE_NO_POLYGON = (24,)
# Fixture geographic placement of zone units (degrees per unit and origin).
FIXTURE_LON0 = 139.5
FIXTURE_LAT0 = 35.5
FIXTURE_DEG_PER_UNIT = 1.0 / 250.0

# --- fixture: rings that cross, touch or overlap themselves -------------------
# by supplier key mod 4: bow-tie, five-pointed star, loop that meets itself, ring around a hole
FIXTURE_CROSSED_RINGS = (
    ((0, 0), (8, 6), (8, 0), (0, 6)),
    ((0, 6), (12, 6), (2, 14), (6, 0), (10, 14)),
    ((0, 0), (10, 0), (10, 10), (4, 10), (4, 4), (14, 4), (14, 14), (0, 14)),
    ((0, 0), (12, 0), (12, 12), (0, 12), (0, 6), (4, 6), (4, 8), (8, 8), (8, 4), (4, 4), (4, 6), (0, 6)),
)
# one ring with a vertex a part: centre, least radius, spread of radii and its steps
FIXTURE_BIG_RING = (50.0, 30.0, 10.0, 101)
