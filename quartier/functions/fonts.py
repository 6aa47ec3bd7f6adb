"""Bytes of legacy Vietnamese fonts and the letters that they stand for, and replacements for text that went through them."""

from __future__ import annotations

# High bytes of exported sheets.
SHEET_FONT = {
    0x82: "é", 0x83: "â", 0x85: "à", 0x86: "ắ", 0x87: "ặ", 0x88: "ê", 0x89: "ẹ", 0x8A: "è", 0x8B: "ồ", 0x8D: "ì", 0x8E: "ợ", 0x8F: "ở", 0x90: "ớ", 0x93: "ồ", 0x94: "ụ",
    0x95: "ò", 0x96: "ừ", 0x97: "ằ", 0x98: "ự", 0x99: "ơ", 0x9A: "ứ", 0x9B: "ữ", 0x9C: "ỳ", 0x9D: "ỵ", 0x9E: "ỷ", 0x9F: "ỹ", 0xA0: "á", 0xA1: "í", 0xA2: "ó", 0xA3: "ú",
}

# The lower-case letters of TCVN 5712, with its upper-case vowels without marks.
TCVN3 = {
    0xA1: "Ă", 0xA2: "Â", 0xA3: "Ê", 0xA4: "Ô", 0xA5: "Ơ", 0xA6: "Ư", 0xA7: "Đ", 0xA8: "ă", 0xA9: "â", 0xAA: "ê", 0xAB: "ô", 0xAC: "ơ", 0xAD: "ư", 0xAE: "đ",
    0xB5: "à", 0xB6: "ả", 0xB7: "ã", 0xB8: "á", 0xB9: "ạ", 0xBB: "ằ", 0xBC: "ẳ", 0xBD: "ẵ", 0xBE: "ắ", 0xC6: "ặ", 0xC7: "ầ", 0xC8: "ẩ", 0xC9: "ẫ", 0xCA: "ấ", 0xCB: "ậ",
    0xCC: "è", 0xCE: "ẻ", 0xCF: "ẽ", 0xD0: "é", 0xD1: "ẹ", 0xD2: "ề", 0xD3: "ể", 0xD4: "ễ", 0xD5: "ế", 0xD6: "ệ", 0xD7: "ì", 0xD8: "ỉ", 0xDC: "ĩ", 0xDD: "í", 0xDE: "ị",
    0xDF: "ò", 0xE1: "ỏ", 0xE2: "õ", 0xE3: "ó", 0xE4: "ọ", 0xE5: "ồ", 0xE6: "ổ", 0xE7: "ỗ", 0xE8: "ố", 0xE9: "ộ", 0xEA: "ờ", 0xEB: "ở", 0xEC: "ỡ", 0xED: "ớ", 0xEE: "ợ",
    0xEF: "ù", 0xF1: "ủ", 0xF2: "ũ", 0xF3: "ú", 0xF4: "ụ", 0xF5: "ừ", 0xF6: "ử", 0xF7: "ữ", 0xF8: "ứ", 0xF9: "ự", 0xFA: "ỳ", 0xFB: "ỷ", 0xFC: "ỹ", 0xFD: "ý", 0xFE: "ỵ",
}

# Names in which letters were lost, in the order of repair.
LOST_LETTERS = {
    "Qu?ng Ninh": "Quảng Ninh", "Qu?ng Nam": "Quảng Nam", "Qu?ng Ng?i": "Quảng Ngãi", "Qu?ng Tr?": "Quảng Trị", "Hà N?i": "Hà Nội", "Ba ?ình": "Ba Đình",
    "Ng?c Hà": "Ngọc Hà", "Thành ph?": "Thành phố", "??": "Đ", "?ình": "Đình", "ph?": "phố", "N?i": "Nội", "Ng?c": "Ngọc",
}
