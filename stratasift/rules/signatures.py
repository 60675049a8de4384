"""Magic numbers, extension contexts and category groups. Small tables: joins broadcast them."""

from __future__ import annotations

#: Magic in hex, format, category, offset, extension, engine, confidence, embeddable; in table order.
SIGNATURES = [
    ("504B0304", "ZIP", "archive", 0, "zip", None, 0.95, True),
    ("504B0506", "ZIP (empty)", "archive", 0, "zip", None, 0.7, False),
    ("377ABCAF271C", "7-Zip", "archive", 0, "7z", None, 0.95, True),
    ("526172211A0700", "RAR4", "archive", 0, "rar", None, 0.95, True),
    ("526172211A070100", "RAR5", "archive", 0, "rar", None, 0.95, True),
    ("1F8B08", "GZIP", "compressed", 0, "gz", None, 0.95, True),
    ("425A68", "BZIP2", "compressed", 0, "bz2", None, 0.85, False),
    ("FD377A585A00", "XZ", "compressed", 0, "xz", None, 0.95, True),
    ("04224D18", "LZ4 frame", "compressed", 0, "lz4", None, 0.95, False),
    ("28B52FFD", "Zstandard", "compressed", 0, "zst", None, 0.95, True),
    ("4D534346", "Microsoft Cabinet", "archive", 0, "cab", None, 0.95, True),
    ("7573746172", "TAR", "archive", 257, "tar", None, 0.9, False),
    ("4344303031", "ISO 9660", "disc_image", 0x8001, "iso", None, 0.95, False),
    ("4344303031", "ISO 9660 (2352 raw sectors)", "disc_image", 0x9319, "bin", None, 0.9, False),
    ("014344303031", "ISO 9660 PVD", "disc_image", 0x8000, "iso", None, 0.95, False),
    ("4D4943524F534F46542A58424F582A4D45444941", "Xbox XDVDFS", "disc_image", 0x10000, "iso", None, 0.95, False),
    ("4D5A", "PE/DOS executable", "executable", 0, "exe", None, 0.6, False),
    ("7F454C46", "ELF executable", "executable", 0, "", None, 0.9, False),
    ("50532D5820455845", "PlayStation 1 executable", "executable", 0, "exe", "PS1", 0.95, False),
    ("89504E470D0A1A0A", "PNG", "texture", 0, "png", None, 0.95, True),
    ("FFD8FF", "JPEG", "texture", 0, "jpg", None, 0.95, True),
    ("474946383761", "GIF", "texture", 0, "gif", None, 0.95, True),
    ("474946383961", "GIF", "texture", 0, "gif", None, 0.95, True),
    ("424D", "BMP", "texture", 0, "bmp", None, 0.55, False),
    ("44445320", "DirectDraw Surface", "texture", 0, "dds", None, 0.95, True),
    ("AB4B5458203131BB0D0A1A0A", "KTX", "texture", 0, "ktx", None, 0.95, True),
    ("AB4B5458203230BB0D0A1A0A", "KTX2", "texture", 0, "ktx2", None, 0.95, True),
    ("52494646", "RIFF container (WEBP/WAV/AVI)", "other", 0, "", None, 0.4, False),
    ("49492A00", "TIFF (LE)", "texture", 0, "tif", None, 0.7, False),
    ("4D4D002A", "TIFF (BE)", "texture", 0, "tif", None, 0.7, False),
    ("0000000C6A502020", "JPEG 2000", "texture", 0, "jp2", None, 0.8, False),
    ("50565203", "PowerVR texture", "texture", 0, "pvr", None, 0.95, True),
    ("47696478", "Sony GIM texture", "texture", 0, "gim", None, 0.8, False),
    ("0200000054494D", "Sony TIM texture", "texture", 0, "tim", None, 0.6, False),
    ("676C5446", "GLB (glTF binary)", "model", 0, "glb", None, 0.95, True),
    ("4B6179646172612046425820 42696E617279".replace(" ", ""), "FBX (binary)", "model", 0, "fbx", None, 0.95, True),
    ("706C790A", "PLY", "model", 0, "ply", None, 0.9, False),
    ("706C790D0A", "PLY", "model", 0, "ply", None, 0.9, False),
    ("736F6C696420", "STL (ascii)", "model", 0, "stl", None, 0.6, False),
    ("49445032", "Quake II MD2", "model", 0, "md2", "id Tech 2", 0.95, False),
    ("49445033", "Quake III MD3", "model", 0, "md3", "id Tech 3", 0.95, False),
    ("49445354", "Valve/GoldSrc MDL", "model", 0, "mdl", "Source", 0.95, False),
    ("49445351", "Valve MDL sequence", "animation", 0, "mdl", "Source", 0.95, False),
    ("56544600", "Valve Texture Format", "texture", 0, "vtf", "Source", 0.95, False),
    ("534D44", "Valve StudioMdl Data", "model", 0, "smd", "Source", 0.5, False),
    ("556E6974794653", "Unity AssetBundle (FS)", "game_container", 0, "bundle", "Unity", 0.95, True),
    ("556E697479576562", "Unity AssetBundle (Web)", "game_container", 0, "", "Unity", 0.95, False),
    ("556E697479526177", "Unity AssetBundle (Raw)", "game_container", 0, "", "Unity", 0.95, False),
    ("556E69747941726368697665", "Unity Archive", "game_container", 0, "", "Unity", 0.95, False),
    ("C1832A9E", "Unreal package (UE3/UE4 .pak legacy)", "game_container", 0, "", "Unreal", 0.95, False),
    ("9E2A83C1", "Unreal package (UPK)", "game_container", 0, "", "Unreal", 0.95, False),
    ("47445043", "Godot PCK", "game_container", 0, "pck", "Godot", 0.95, False),
    ("52534346", "Godot resource", "game_container", 0, "", "Godot", 0.7, False),
    ("43727954656B", "CryEngine resource", "game_container", 0, "", "CryEngine", 0.7, False),
    ("56504B3412", "Valve VPK", "game_container", 0, "vpk", "Source", 0.95, False),
    ("57414433", "GoldSrc WAD", "game_container", 0, "wad", "GoldSrc", 0.95, False),
    ("49574144", "Doom IWAD", "game_container", 0, "wad", "id Tech 1", 0.95, False),
    ("50574144", "Doom PWAD", "game_container", 0, "wad", "id Tech 1", 0.95, False),
    ("5041434B", "Quake PAK", "game_container", 0, "pak", "id Tech", 0.95, False),
    ("42534100", "Bethesda BSA", "game_container", 0, "bsa", "Gamebryo", 0.95, False),
    ("42544458", "Bethesda BA2", "game_container", 0, "ba2", "Creation", 0.95, False),
    ("584E42", "XNA content", "game_container", 0, "xnb", "XNA", 0.7, False),
    ("4F676753", "OGG", "audio", 0, "ogg", None, 0.95, True),
    ("664C6143", "FLAC", "audio", 0, "flac", None, 0.95, True),
    ("494433", "MP3 (ID3)", "audio", 0, "mp3", None, 0.7, False),
    ("46534235", "FMOD sound bank", "audio", 0, "fsb", None, 0.9, False),
    ("52494658", "RIFF (big endian)", "other", 0, "", None, 0.4, False),
    ("424B4844", "Wwise SoundBank", "audio", 0, "bnk", None, 0.9, False),
    ("70424156", "Sony VAB body", "audio", 0, "vb", None, 0.6, False),
    ("56414770", "Sony VAG audio", "audio", 0, "vag", None, 0.95, True),
    ("53434500", "PSP/PS3 signed module", "executable", 0, "", None, 0.7, False),
    ("7E505350", "PSP PBP", "game_container", 0, "pbp", None, 0.8, False),
    ("00505346", "PSF container", "game_container", 0, "", None, 0.7, False),
    ("4E50554D44494D47", "PSP UMD image", "disc_image", 0, "", None, 0.9, False),
]

#: Extensions that hint at a category, with the confidence of the hint.
EXTENSION_CONTEXT = {
    "model": (0.35, "obj fbx gltf glb dae ply stl 3ds blend md5mesh"),
    "texture": (0.35, "png jpg jpeg tga bmp dds ktx ktx2 psd tif"),
    "animation": (0.35, "bvh anim md5anim smd"),
    "archive": (0.30, "zip 7z rar tar gz bz2 xz cab pak pk3 pk4"),
    "disc_image": (0.30, "iso img cue cdi mdf mds nrg gcm wbfs"),
}

#: Categories whose files hold further files.
CONTAINER_CATEGORIES = ("archive", "disc_image", "compressed", "game_container")


def extension_rows() -> list[tuple[str, str, float]]:
    return [(ext, category, confidence) for category, (confidence, names) in EXTENSION_CONTEXT.items() for ext in names.split()]
