"""Names that serialized type trees refer to by their byte place in a built-in table."""

from __future__ import annotations

#: Fixed values, in table order; a name's place is the bytes of those before it, each with a NUL.
COMMON_STRINGS = (
    "AABB AnimationClip AnimationCurve AnimationState Array Base BitField bitset bool char ColorRGBA Component data deque double dynamic_array FastPropertyName first float Font GameObject "
    "Generic_Mono GradientNEW GUID GUIStyle int list long_long map Matrix4x4f MdFour MonoBehaviour MonoScript m_ByteSize m_Curve m_EditorClassIdentifier m_EditorHideFlags m_Enabled m_ExtensionPtr "
    "m_GameObject m_Index m_IsArray m_IsStatic m_MetaFlag m_Name m_ObjectHideFlags m_PrefabInternal m_PrefabParentObject m_Script m_StaticEditorFlags m_Type m_Version Object pair PPtr<Component> "
    "PPtr<GameObject> PPtr<Material> PPtr<MonoBehaviour> PPtr<MonoScript> PPtr<Object> PPtr<Prefab> PPtr<Sprite> PPtr<TextAsset> PPtr<Texture> PPtr<Texture2D> PPtr<Transform> Prefab Quaternionf Rectf RectInt "
    "RectOffset second set short size SInt16 SInt32 SInt64 SInt8 staticvector string TextAsset TextMesh Texture Texture2D Transform TypelessData UInt16 UInt32 UInt64 UInt8 unsigned_int "
    "unsigned_long_long unsigned_short vector Vector2f Vector3f Vector4f m_ScriptingClassIdentifier Gradient Type* int2_storage int3_storage BoundsInt m_CorrespondingSourceObject m_PrefabInstance m_PrefabAsset "
    "FileSize Hash128"
).split()
#: The entries above whose underscores stand for blanks.
SPACED = ("Generic_Mono", "long_long", "unsigned_int", "unsigned_long_long", "unsigned_short")


def string_table() -> dict[int, str]:
    """Names by their byte place."""
    out, at = {}, 0
    for name in COMMON_STRINGS:
        out[at] = name.replace("_", " ") if name in SPACED else name
        at += len(name) + 1
    return out
