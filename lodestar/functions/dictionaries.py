"""Word lists that results depend on."""

# fixed values: Vietnamese stop words
STOP_WORDS = """
và để là của do được tại từ vào với có cái cần các như thì hoặc nhưng hay nếu khi mà cũng lại hơn trong trên dưới
chỉ bao xung quanh nhân lên xuống ra qua một mấy những cây chiếc chuỗi nước mỗi tất cả nhiều ít toàn bộ phần
rất quá tương đối gần xa đủ khoảng
""".split()

# fixed values: industry phrases kept as one token
INDUSTRY_PHRASES = [p.strip() for p in """
dệt may, sợi dệt, vải dệt, vải không dệt, nhuộm vải, may mặc, nguyên phụ liệu, phụ liệu may mặc, công nghiệp dệt may,
điện lực, điện năng, thiết bị điện, cơ điện, năng lượng, năng lượng tái tạo, điện mặt trời, điện gió, điện tử,
linh kiện điện tử, thiết bị điện tử, điện gia dụng, đồ điện gia dụng, điện lạnh, công nghệ, công nghệ thông tin, phần mềm,
dữ liệu lớn, trang thiết bị y tế, dược phẩm, y tế, phòng khám, vận tải, kho bãi, xây dựng, vật liệu xây dựng, tài chính,
ngân hàng, bảo hiểm, bán lẻ, bán buôn, thực phẩm, ăn uống, dịch vụ ăn uống, nhà hàng, quán ăn, đồ uống
""".replace("\n", " ").split(",")]

# fixed values: cities and provinces kept as one token
CITY_PHRASES = [p.strip() for p in """
hà nội, hồ chí minh, đà nẵng, hải phòng, cần thơ, thái nguyên, tuyên quang, sơn la, bắc ninh, phú thọ, yên bái, hòa bình,
lạng sơn, cao bằng, quảng ninh, thanh hóa, nghệ an, hà tĩnh, quảng bình, quảng trị, thừa thiên huế, quảng nam, quảng ngãi,
bình định, phú yên, khánh hòa, ninh thuận, bình thuận, long an, đồng tháp, an giang, kiên giang, cà mau, bến tre, trà vinh,
vĩnh long, tiền giang, bình dương, bình phước, đồng nai, tây ninh, lâm đồng, đắk lắk, đắk nông, điện biên, lai châu, hà giang
""".replace("\n", " ").split(",")]

# fixed values: places that the fused search and the filters look for in a query
SEARCH_PLACES = [p.strip() for p in """
hà nội, hồ chí minh, đà nẵng, hải phòng, cần thơ, bình dương, đồng nai, long an, bình định, khánh hòa, thanh hóa, nghệ an,
thái nguyên, bắc ninh, quảng ninh, lâm đồng, đắk lắk, bình thuận, tây ninh, bình phước, hà tĩnh, quảng nam, quảng ngãi,
phú yên, vĩnh long, tiền giang, bến tre, trà vinh, an giang, kiên giang, cà mau, đồng tháp, hải dương, hưng yên, nam định,
ninh bình, thái bình, vĩnh phúc, bắc giang, phú thọ, yên bái, hòa bình, lạng sơn, cao bằng, điện biên, lai châu, hà giang,
tuyên quang, sơn la
""".replace("\n", " ").split(",")]

#: The vector search knows only the first 25 of them.
VECTOR_PLACES = SEARCH_PLACES[:25]


def _lists(text: str) -> dict[str, list[str]]:
    return {k.strip(): v.split() for k, v in (line.split(":") for line in text.strip().splitlines())}


# fixed values: expansions of single terms, used where no intent group is met
EXPANSIONS = _lists("""
electric: điện_lực điện_năng phát_điện truyền_tải_điện phân_phối_điện
electricity: điện_lực điện_năng phát_điện truyền_tải_điện phân_phối_điện
power: điện_lực điện_năng phát_điện
energy: năng_lượng năng_lượng_tái_tạo điện_mặt_trời điện_gió
renewable: năng_lượng_tái_tạo điện_mặt_trời điện_gió
electronics: điện_tử linh_kiện_điện_tử thiết_bị_điện_tử
electronic: điện_tử linh_kiện_điện_tử thiết_bị_điện_tử
electrical: thiết_bị_điện cơ_điện điện_công_nghiệp
textile: dệt_may sợi_dệt vải_dệt nhuộm_vải
fabric: vải vải_dệt vải_không_dệt
garment: may_mặc phụ_liệu_may_mặc dệt_may
weaving: sợi_dệt vải_dệt dệt_may
technology: công_nghệ_thông_tin phần_mềm dữ_liệu_lớn
software: phần_mềm công_nghệ_thông_tin
công_nghệ: công_nghệ_thông_tin phần_mềm dữ_liệu_lớn
công_nghệ_thông_tin: công_nghệ phần_mềm dữ_liệu_lớn
it: công_nghệ_thông_tin phần_mềm
medical: y_tế trang_thiết_bị_y_tế phòng_khám bệnh_viện
pharma: dược_phẩm thuốc y_tế
construction: xây_dựng vật_liệu_xây_dựng công_trình
logistics: vận_tải kho_bãi logistics
finance: tài_chính ngân_hàng bảo_hiểm
bank: ngân_hàng tài_chính
retail: bán_lẻ cửa_hàng
food: thực_phẩm ăn_uống dịch_vụ_ăn_uống nhà_hàng quán_ăn đồ_uống
restaurant: nhà_hàng quán_ăn dịch_vụ_ăn_uống
beverage: đồ_uống ăn_uống
""")

# fixed values: intent groups' triggers
TRIGGERS = _lists("""
electric_power: electric electricity power điện_lực điện_năng phát_điện
energy: energy renewable năng_lượng năng_lượng_tái_tạo điện_gió điện_mặt_trời
electronics: electronics electronic electrical điện_tử thiết_bị_điện_tử thiết_bị_điện
home_appliance: gia_dụng điện_gia_dụng đồ_điện_gia_dụng điện_lạnh appliance appliances
textile: textile fabric weaving dệt_may vải nhuộm_vải sợi_dệt
garment: garment may_mặc phụ_liệu_may_mặc
technology: technology software it công_nghệ công_nghệ_thông_tin phần_mềm
food_service: food restaurant beverage thực_phẩm ăn_uống dịch_vụ_ăn_uống nhà_hàng quán_ăn đồ_uống
""")

# fixed values: intent groups' expansions
GROUP_EXPANSIONS = _lists("""
electric_power: điện_lực điện_năng phát_điện truyền_tải_điện phân_phối_điện
energy: năng_lượng năng_lượng_tái_tạo điện_mặt_trời điện_gió
electronics: điện_tử linh_kiện_điện_tử thiết_bị_điện_tử thiết_bị_điện cơ_điện
home_appliance: điện_gia_dụng đồ_điện_gia_dụng điện_lạnh thiết_bị_điện
textile: dệt_may sợi_dệt vải_dệt vải_không_dệt nhuộm_vải
garment: may_mặc phụ_liệu_may_mặc dệt_may
technology: công_nghệ công_nghệ_thông_tin phần_mềm dữ_liệu_lớn
food_service: thực_phẩm ăn_uống dịch_vụ_ăn_uống nhà_hàng quán_ăn đồ_uống
""")

# fixed values: which group wins if several are met
GROUP_PRIORITY = "electric_power electronics home_appliance technology food_service energy textile garment".split()

# fixed values: terms that a document of an intent must have, and those that it must not have
MUST = _lists("""
electric_power: điện_lực điện_năng phát_điện truyền_tải_điện phân_phối_điện
electronics: điện_tử linh_kiện_điện_tử thiết_bị_điện_tử
home_appliance: điện_gia_dụng đồ_điện_gia_dụng điện_lạnh thiết_bị_điện
food_service: thực_phẩm ăn_uống dịch_vụ_ăn_uống nhà_hàng quán_ăn đồ_uống
""")
MUST_NOT = _lists("""
electric_power: điện_tử linh_kiện_điện_tử thiết_bị_điện_tử điện_gia_dụng đồ_điện_gia_dụng điện_lạnh
electronics: điện_lực điện_năng phát_điện truyền_tải_điện phân_phối_điện
home_appliance: điện_lực điện_năng phát_điện
food_service: dược_phẩm thuốc y_tế mỹ_phẩm
""")

# fixed values: words that carry no intent
GENERIC = """
company companies enterprise business corporation corp co ltd industry industries doanh nghiệp công ty cty dn ngành nghề
nhà hàng cửa
""".split()

# fixed values: the evaluation's queries, keywords and descriptions
EVALUATION = [tuple(x.strip() for x in line.split("|")) for line in """
công ty công nghệ | công nghệ, phần mềm, cntt | Technology company
nhà hàng hà nội | nhà hàng, ăn uống, quán | Restaurant in Hanoi
xây dựng bất động sản | xây dựng, bất động sản, nhà đất | Construction and real estate
dịch vụ du lịch | du lịch, lữ hành, khách sạn | Tourism services
phần mềm quản lý bán hàng | phần mềm, quản lý, bán hàng | Sales management software
tài chính ngân hàng | tài chính, ngân hàng, đầu tư | Financial services
sản xuất đồ gia dụng | sản xuất, gia dụng | Household appliance manufacturing
vận chuyển hàng hóa | vận chuyển, logistics, vận tải | Shipping and logistics
marketing quảng cáo | marketing, quảng cáo, truyền thông | Marketing and advertising
may mặc thời trang | may mặc, thời trang, quần áo | Fashion and clothing
nông sản xuất khẩu | nông sản, xuất khẩu, nông nghiệp | Agricultural products export
phòng tập gym thể thao | gym, fitness, thể thao | Gym and fitness services
dầu khí năng lượng | dầu khí, năng lượng, dầu mỏ | Oil, gas and energy
dược phẩm y tế | dược phẩm, thuốc, y tế | Pharmaceutical company
giáo dục đào tạo | giáo dục, đào tạo, trường học | Education and training
ô tô xe hơi | ô tô, xe hơi, ô tô xe máy | Automobile retail
viễn thông internet | viễn thông, internet, cáp quang | Telecommunications
điện tử linh kiện | điện tử, linh kiện, thiết bị điện tử | Electronics and components
nhân sự tuyển dụng | nhân sự, tuyển dụng, hr | HR and recruitment
shipping logistics | vận chuyển, logistics, giao nhận | Cross-lingual: shipping logistics
""".strip().splitlines()]

# fixed values: Vietnamese letters and the ASCII letters they fold to
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
FOLDED = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"

# fixed values: names of administrative units in addresses
ADMIN_UNITS = ["Phường", "Xã", "Tỉnh", "Quận", "Thành phố", "TX", "TT", "Huyện", "TP", "Thị xã", "Thị trấn", "Khu phố",
               "Tổ dân phố", "Việt Nam", "Vietnam"]
