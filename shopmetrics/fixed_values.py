"""Values that results must carry literally.

Everything in this file is a fixed value: identifiers, labels, texts and
constants that appear in (or decide) the results. No logic lives here.
"""

# --- fixed values: source labels and defaults -------------------------------
PRIMARY_PLATFORM = "Tiki"
PRIMARY_URL_PREFIX = "https://tiki.vn/"
MARKETPLACE_PLATFORM = "Kaggle"
MARKETPLACE_URL_PREFIX = "https://kaggle.com/product/"
UNKNOWN_PLATFORM = "Chưa xác định"
UNKNOWN_CATEGORY = "Chưa phân loại"
CATEGORY_PREFIX = "Ngành "

# --- fixed values: category ids, families first, then the detailed map ------
PARENT_CATEGORIES = {
    "8322": "Sách tiếng Việt",
    "316": "Sách ngoại văn",
    "1084": "Truyện tranh/Manga",
    "67998": "Sách thiếu nhi",
    "1789": "Điện thoại - Máy tính bảng",
    "915": "Thời trang nam",
    "931": "Thời trang nữ",
    "1520": "Làm đẹp - Sức khỏe",
    "1883": "Nhà cửa - Đời sống",
}
DETAIL_CATEGORIES = {
    "8322": "Sách tiếng Việt",
    "316": "Sách ngoại văn",
    "1084": "Truyện tranh/Manga",
    "67998": "Sách thiếu nhi",
    "871": "Tô màu - Luyện chữ",
    "67867": "Đồ chơi học tập",
    "6750": "Đồ chơi thương hiệu",
    "67996": "Sản phẩm cho bé",
    "915": "Thời trang nam",
    "931": "Thời trang nữ",
    "11": "Áo nam (Cũ)",
    "12": "Quần nam",
    "13": "Giày nam",
    "14": "Áo nữ",
    "15": "Quần nữ",
    "16": "Giày nữ",
    "17": "Phụ kiện thời trang",
    "1789": "Điện thoại - Máy tính bảng",
    "1815": "Thiết bị số - Phụ kiện",
    "1": "Điện thoại (Cũ)",
    "2": "Tablet",
    "3": "Laptop",
    "4": "Tai nghe",
    "5": "Phụ kiện điện thoại",
    "1520": "Làm đẹp - Sức khỏe",
    "385": "Mỹ phẩm (Cũ)",
    "664": "Chăm sóc da",
    "1754": "Máy massage",
    "2250": "Dụng cụ làm đẹp",
    "853": "Vitamin & Thực phẩm bổ sung",
    "847": "Chăm sóc cơ thể",
    "840": "Kem dưỡng ẩm",
    "843": "Mặt nạ/Serum",
    "844": "Tẩy rửa mặt",
    "845": "Nước hoa",
    "1883": "Nhà cửa - Đời sống",
    "4384": "Bách hóa online",
    "9725": "Đèn chiếu sáng",
    "67869": "Thiết bị nhà bếp",
    "67871": "Thiết bị phòng tắm",
    "67915": "Nệm & Gối",
}

# --- fixed values: outlier rule, score weights, thresholds ------------------
IQR_MULTIPLIER = 1.5
Z_THRESHOLD = 3.0
STD_EPSILON = 1e-10
SCORE_WEIGHTS = {
    "price": 0.40,
    "rating": 0.30,
    "units_sold": 0.20,
    "discount_ratio": 0.10,
}
WEIGHT_TOLERANCE = 1e-6
MIN_CATEGORY_FOR_PERCENTILE = 5
MIN_CATEGORY_FOR_ADVICE = 3
RATING_TOLERANCE = 0.5
SAFE_RATING = 4.0
HIGH_DISCOUNT = 0.2
SIGNIFICANCE = 0.05

# --- fixed values: group labels ---------------------------------------------
DISCOUNT_ABOVE = "Giảm > 20%"
DISCOUNT_BELOW = "Giảm <= 20%"
SIGNIFICANT_TEXT = "Có khác biệt ý nghĩa"
NOT_SIGNIFICANT_TEXT = "Không khác biệt ý nghĩa"
COUNT_LABEL = "%s (%d sản phẩm)"

# --- fixed values: segment names and descriptions ---------------------------
TIER_CHEAP = "Rẻ"
TIER_MIDDLE = "Tầm trung"
TIER_EXPENSIVE = "Đắt"
NAME_SEPARATOR = " - "
GROUP_SUFFIX = " (nhóm %d)"
SEGMENT_SIDES = {
    (TIER_CHEAP, True): "Đáng tin",
    (TIER_CHEAP, False): "Đáng ngờ",
    (TIER_MIDDLE, True): "Ổn định",
    (TIER_MIDDLE, False): "Cần xem xét",
    (TIER_EXPENSIVE, True): "Xắt ra miếng",
    (TIER_EXPENSIVE, False): "Cần cân nhắc",
}
SEGMENT_DESCRIPTIONS = {
    (TIER_CHEAP, True): (
        "Giá thuộc nhóm thấp nhất và rating tốt hơn các cụm giá thấp khác - "
        "đây là nhóm 'hời thật sự', ưu tiên gợi ý hàng đầu."
    ),
    (TIER_CHEAP, False): (
        "Giá thấp nhưng rating kém hơn các cụm giá thấp khác - nghi ngờ chất "
        "lượng hoặc giảm giá ảo, cần cảnh báo người dùng."
    ),
    (TIER_MIDDLE, True): (
        "Giá và rating ở mức trung bình, cân bằng, ít rủi ro - lựa chọn an "
        "toàn khi không có nhu cầu đặc biệt."
    ),
    (TIER_MIDDLE, False): (
        "Giá tầm trung nhưng rating dưới trung vị nhóm tầm trung - còn nhiều "
        "lựa chọn tốt hơn cùng tầm giá."
    ),
    (TIER_EXPENSIVE, True): (
        "Giá thuộc nhóm cao nhất nhưng rating cũng cao hơn các cụm giá cao "
        "khác - hợp lý cho người ưu tiên chất lượng."
    ),
    (TIER_EXPENSIVE, False): (
        "Giá thuộc nhóm cao nhất nhưng rating không tương xứng so với các cụm "
        "giá cao khác - nên ưu tiên tìm thay thế."
    ),
}

# --- fixed values: notes of the shopping assistant --------------------------
NOTE_PERCENTILE = "%d%% trong tổng số %d sản phẩm cùng ngành '%s' rẻ hơn."
NOTE_PERCENTILE_TOO_FEW = (
    "Ngành '%s' chỉ có %d sản phẩm trong dữ liệu - không đủ để tính percentile "
    "đáng tin cậy."
)
NOTE_STRICT = "Cùng ngành hàng, rẻ hơn, rating tương đương."
NOTE_RELAXED = (
    "Cùng ngành hàng, rẻ hơn (đã nới điều kiện rating do ít lựa chọn)."
)
NOTE_FEW = " Chỉ tìm được %d/3 lựa chọn phù hợp trong dữ liệu."
NOTE_NONE = (
    "Không tìm thấy sản phẩm nào rẻ hơn trong ngành '%s' trong tập dữ liệu "
    "hiện có."
)
REASON_BUDGET = "💡 Rẻ hơn ngân sách %s%%"
REASON_EXCELLENT = ", đánh giá cao vượt trội (%s ⭐ so với TB %s)"
REASON_SAFE = ", mức đánh giá an toàn (%s ⭐)"
REASON_BEST_SELLER = ", và thuộc top bán chạy (%s lượt)."
REASON_END = "."

# --- fixed values: page previews --------------------------------------------
PREVIEW_DEFAULT_TITLE = "Không có tiêu đề"
PREVIEW_DEFAULT_DESCRIPTION = ""
PREVIEW_NO_IMAGE = "Không có ảnh"
